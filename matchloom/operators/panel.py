"""Panel analytics: activity, survival, regimes and distribution summaries over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions.scalar import gap_bucket
from matchloom.operators.relational import lag_in_cells


def fraction_active(df: DataFrame, entity: str, period: Column) -> DataFrame:
    """period, n_active, n_ever, fraction_active: the part of all entities ever seen that
    has a row in the period. Null entities and periods don't count.

    One shuffle of distinct (entity, period); the constant denominator is a one-row
    broadcast made of the same distinct rows."""
    d = df.select(F.col(entity).alias("e"), period.alias("period")).where("e is not null and period is not null").distinct()
    ever = d.agg(F.countDistinct("e").alias("n_ever"))
    return d.groupBy("period").agg(F.count("*").alias("n_active")).crossJoin(F.broadcast(ever)).withColumn("fraction_active", F.col("n_active") / F.col("n_ever"))


def with_churn(activity: DataFrame) -> DataFrame:
    """fraction_active's result with churn: 1 minus the previous period's fraction; the
    first period takes its own. Its few rows are one per period."""
    w = Window.partitionBy(F.lit(0)).orderBy("period")
    return activity.withColumn("churn", 1 - F.coalesce(F.lag("fraction_active").over(w), "fraction_active"))


def cohort(df: DataFrame, entity: str, at: str, least: int, span_days: int) -> DataFrame:
    """entity, n, first, last: entities with at least so many rows that span so many days."""
    g = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    days = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 86_400e6
    return g.where((F.col("n") >= least) & (days >= span_days))


def rate_by_regime(df: DataFrame, regime: list[str], hit: Column, least: int = 1) -> DataFrame:
    """regime, n, rate: share of rows for which `hit` holds (null: doesn't count), for
    regimes with at least so many rows that count."""
    h = hit.cast("int")
    return df.groupBy(*regime).agg(F.count(h).alias("n"), F.avg(h).alias("rate")).where(F.col("n") >= least)


def robust_summary(df: DataFrame, keys: list[str], x: Column, good: Column) -> DataFrame:
    """keys, n, mean, median, p5, p95, iqr, sd, bad_rate, and mean_good, median_good over
    the rows for which `good` holds. Null values don't count, but as rows."""
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    ok = F.coalesce(good, F.lit(False))
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), q.alias("__q"), F.stddev_samp(x).alias("sd"), F.avg((~ok).cast("int")).alias("bad_rate"), F.avg(F.when(ok, x)).alias("mean_good"), F.median(F.when(ok, x)).alias("median_good"))
    at = lambda i: F.col("__q")[i]
    return g.select(*keys, "n", "mean", at(2).alias("median"), at(0).alias("p5"), at(4).alias("p95"), (at(3) - at(1)).alias("iqr"), "sd", "bad_rate", "mean_good", "median_good")


def name_multiplicity(df: DataFrame, a: str, b: str) -> DataFrame:
    """direction, n_others, n_keys: how many b an a has, and the other way round."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    side = lambda k, label: d.groupBy(k).agg(F.count("*").alias("n_others")).groupBy("n_others").agg(F.count("*").alias("n_keys")).select(F.lit(label).alias("direction"), "n_others", "n_keys")
    return side(a, "a_to_b").unionByName(side(b, "b_to_a"))


def overlap_classes(df: DataFrame, shared: str, entity: str, at: str) -> DataFrame:
    """shared, entity_a, entity_b, class: pairs of entities with one shared attribute,
    A: the first ended before the second began, B: they overlap, C: one lies within the
    other. For attributes that few entities share."""
    s = df.where(F.col(shared).isNotNull() & F.col(entity).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(shared).alias("__k"), F.col(entity).alias("__x")).agg(F.min(at).alias("__s"), F.max(at).alias("__e"))
    a = s.select("__k", F.col("__x").alias("__a"), F.col("__s").alias("__s1"), F.col("__e").alias("__e1"))
    b = s.select("__k", F.col("__x").alias("__b"), F.col("__s").alias("__s2"), F.col("__e").alias("__e2"))
    j = a.join(b, "__k").where("__s1 < __s2 or (__s1 = __s2 and __a < __b)")
    kind = F.when(F.col("__e1") < F.col("__s2"), "A").when(F.col("__e2") <= F.col("__e1"), "C").otherwise("B")
    return j.select(F.col("__k").alias(shared), F.col("__a").alias("entity_a"), F.col("__b").alias("entity_b"), kind.alias("class"))


def rename_gaps(df: DataFrame, entity: str, name: str, at: str) -> DataFrame:
    """entity, name, next_name, gap_days: successive names of an entity by first use, and
    the time from the last use of one to the first of the next (negative: they overlap)."""
    s = df.where(F.col(entity).isNotNull() & F.col(name).isNotNull() & F.col(at).isNotNull()).groupBy(entity, name).agg(F.min(at).alias("__s"), F.max(at).alias("__e"))
    w = Window.partitionBy(entity).orderBy("__s", name)
    s = s.withColumn("next_name", F.lead(name).over(w)).withColumn("__n", F.lead("__s").over(w)).where("next_name is not null")
    return s.select(entity, name, "next_name", ((F.unix_micros(F.col("__n").cast("timestamp")) - F.unix_micros(F.col("__e").cast("timestamp"))) / 86_400e6).alias("gap_days"))


def prior_count_shortfall(df: DataFrame, narrow: list[str], wide: list[str], at: str, cap: int) -> DataFrame:
    """One row: how much history is lost under the narrower of two identities: n_rows,
    n_short, mean_narrow, mean_wide of prior counts capped at `cap`. Rows at the same time
    are not prior to each other."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    prior = lambda keys: F.least(F.count("*").over(Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, -1)), F.lit(cap))
    r = df.where(F.col(at).isNotNull()).select(prior(narrow).alias("a"), prior(wide).alias("b"))
    return r.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("a") < F.col("b"), 1)).alias("n_short"), F.avg("a").alias("mean_narrow"), F.avg("b").alias("mean_wide"))


def rating_continuity(df: DataFrame, keys: list[str], ties: list[str], before: str, after: str, at: str, cell_days: int = 28) -> DataFrame:
    """gap, n, n_continues, mean_jump: whether a row's rating before equals the previous
    row's rating after, by the time in between. ties order rows of the same time; nulls
    come last."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    order = [x for c in ties for x in (F.col(c).isNull(), F.col(c))]
    r = lag_in_cells(df, keys, t, order, {"__p": F.col(after), "__t": t}, cell_days * 86_400_000_000)
    days = (t - F.col("__t")) / 86_400e6
    return r.groupBy(gap_bucket(days).alias("gap")).agg(F.count("*").alias("n"), F.count(F.when(F.col("__p") == F.col(before), 1)).alias("n_continues"), F.avg(F.col(before) - F.col("__p")).alias("mean_jump"))
