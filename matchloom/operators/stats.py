"""Distribution drift, effect sizes, rank tests and variance components.

Rows are reduced to histograms, per-group sums or rank sums on the executors; formulas
over those few numbers are column expressions again. What the driver collects is stated
with each function and doesn't grow with the rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.session import discard, materialise

UNSEEN = "__unseen__"


def quantile_edges(ref: DataFrame, x: Column, bins: int = 10) -> list[float]:
    """Equal-frequency bin edges, repeated ones once. It is an error if there are no more
    distinct values than bins. Collects one row."""
    edges, distinct = _quantiles(ref, x, [i / bins for i in range(bins + 1)])
    if distinct <= bins:
        raise ValueError(f"{distinct} distinct values for {bins} bins: treat them as categories")
    return sorted(set(edges))


def exact_quantiles(df: DataFrame, x: Column, shares: list[float]) -> list[float]:
    """The exact quantiles of x, linear between neighbours, nulls left out; empty if there
    is no value. Values are counted and ranked within ranges, so that no task holds all of
    them; the driver gets at most two lines per quantile."""
    return _quantiles(df, x, shares)[0]


def _quantiles(df: DataFrame, x: Column, shares: list[float]) -> tuple[list[float], int]:
    """exact_quantiles, and the number of distinct values."""
    g = _ranked(df, x, F.lit(True))
    t = g.agg(F.sum("a").alias("n"), F.count("*").alias("d")).first()
    if not t["n"]:
        return [], 0
    at = [p * (t["n"] - 1) for p in shares]
    ranks = sorted({k for h in at for k in (math.floor(h), math.ceil(h))})
    hit = F.array(*[F.lit(k) for k in ranks])
    rows = g.select("x", F.explode(F.filter(hit, lambda k: (k >= F.col("ca")) & (k < F.col("ca") + F.col("a")))).alias("k")).collect()
    value = {r["k"]: r["x"] for r in rows}
    return [value[math.floor(h)] + (h - math.floor(h)) * (value[math.ceil(h)] - value[math.floor(h)]) for h in at], t["d"]


def frozen_bin(x: Column, edges: list[float], closed: str = "right") -> Column:
    """x's bin among frozen edges. right: as between the outer edges, bins closed on the
    right, the first one also on the left, nulls in bin 0. left: only inner edges count,
    bins closed on the left, nulls stay null."""
    if closed == "right":
        b = F.lit(0)
        for i, e in enumerate(edges[1:-1], 1):
            b = F.when(x > e, i).otherwise(b)
        return F.coalesce(b, F.lit(0)) if len(edges) > 2 else F.lit(0)
    b = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        b = F.when(x >= e, i).otherwise(b)
    return F.when(x.isNotNull(), b)


def frozen_category(df: DataFrame, x: str, ref: DataFrame, out: str = "category") -> DataFrame:
    """df with `out`: x if the reference has the value, else '__unseen__'; null too."""
    seen = ref.where(F.col(x).isNotNull()).select(F.col(x).cast("string").alias("__c")).distinct()
    return df.join(seen, F.col(x).cast("string") == F.col("__c"), "left").withColumn(out, F.coalesce("__c", F.lit(UNSEEN))).drop("__c")


def psi(ref: DataFrame, test: DataFrame, bin_: str, smoothing: str = "floor", eps: float = 1e-10, skip_unseen: bool = False) -> DataFrame:
    """One row: psi, n_ref, n_test, n_unseen, of two tables that have a column of bins.

    smoothing: floor (shares are at least eps) or add (eps is added to both). With
    skip_unseen, bins that only the tested table has are counted but left out. Either
    table without rows gives null."""
    h = lambda df, n: df.where(F.col(bin_).isNotNull()).groupBy(F.col(bin_).cast("string").alias("b")).agg(F.count("*").alias(n))
    j = h(ref, "r").join(h(test, "t"), "b", "full").select("b", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    total = j.agg(F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    j = j.crossJoin(F.broadcast(total))
    share = lambda c, n: F.greatest(F.col(c) / F.nullif(F.col(n), F.lit(0)), F.lit(eps)) if smoothing == "floor" else F.col(c) / F.nullif(F.col(n), F.lit(0)) + eps
    p, q = share("r", "nr"), share("t", "nt")
    unseen = (F.col("r") == 0) & (F.col("t") > 0)
    term = F.when((F.col("nr") > 0) & (F.col("nt") > 0), (q - p) * F.log(q / p))
    if skip_unseen:
        term = F.when(~unseen, term)
    return j.agg(F.sum(term).alias("psi"), F.coalesce(F.max("nr"), F.lit(0)).alias("n_ref"), F.coalesce(F.max("nt"), F.lit(0)).alias("n_test"), F.coalesce(F.sum(F.when(unseen, F.col("t"))), F.lit(0)).alias("n_unseen"))


def feature_psi(ref: DataFrame, test: DataFrame, x: str, bins: int = 10, **options) -> DataFrame:
    """psi of one feature: quantile bins for numbers, else, or with too few distinct
    values for bins, its values as categories."""
    from pyspark.sql import types as T

    c = F.col(x)
    if isinstance(ref.schema[x].dataType, T.NumericType):
        try:
            edges = quantile_edges(ref, c, bins)
            b = frozen_bin(c.cast("double"), edges)
            return psi(ref.select(b.alias("b")), test.select(b.alias("b")), "b", **options)
        except ValueError:
            pass
    r = ref.select(F.coalesce(c.cast("string"), F.lit("__null__")).alias("b"))
    return psi(r, test.select(F.coalesce(c.cast("string"), F.lit("__null__")).alias("b")), "b", **options)


def cohen_h(p1: Column, p2: Column, signed: bool = True) -> Column:
    h = 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))
    return h if signed else F.abs(h)


def cohen_d(x: Column, first: Column) -> Column:
    """Aggregate: standardised difference of means, rows where `first` holds minus rows
    where it doesn't, by the pooled standard deviation."""
    a, b = F.when(first, x), F.when(~first, x)
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / F.nullif(na + nb - 2, F.lit(0)))
    return (F.avg(a) - F.avg(b)) / F.nullif(pooled, F.lit(0.0))


def _ranked(df: DataFrame, x: Column, first: Column) -> DataFrame:
    """x, a, b, and a and b of all smaller x: counts of two samples by value. Running
    sums are made over values within ranges and over ranges, not in one task."""
    g = df.select(x.cast("double").alias("x"), first.alias("f")).where("x is not null and f is not null").groupBy("x").agg(F.count(F.when(F.col("f"), 1)).alias("a"), F.count(F.when(~F.col("f"), 1)).alias("b"))
    g = g.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    g = materialise(g, "ranked")
    before = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    parts = g.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("pa").over(w), F.lit(0)).alias("pa"), F.coalesce(F.sum("pb").over(w), F.lit(0)).alias("pb"))
    g = g.withColumn("ca", F.coalesce(F.sum("a").over(before), F.lit(0))).withColumn("cb", F.coalesce(F.sum("b").over(before), F.lit(0)))
    return g.join(parts, "part").select("x", "a", "b", (F.col("ca") + F.col("pa")).alias("ca"), (F.col("cb") + F.col("pb")).alias("cb"))


def two_sample_ks(df: DataFrame, x: Column, first: Column) -> DataFrame:
    """One row: ks, the largest distance of the two samples' distribution functions."""
    g = _ranked(df, x, first)
    n = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return g.crossJoin(F.broadcast(n)).agg(F.max(F.abs((F.col("ca") + F.col("a")) / F.nullif(F.col("na"), F.lit(0)) - (F.col("cb") + F.col("b")) / F.nullif(F.col("nb"), F.lit(0)))).alias("ks"), F.max("na").alias("n_first"), F.max("nb").alias("n_second"))


def mann_whitney(df: DataFrame, x: Column, first: Column) -> DataFrame:
    """One row: u of the first sample (ties count half), rank_biserial = 1 - 2u/(n1 n2)."""
    g = _ranked(df, x, first)
    r = g.agg(F.sum(F.col("a") * (F.col("cb") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    return r.select("u", (1 - 2 * F.col("u") / F.nullif(F.col("n1") * F.col("n2"), F.lit(0))).alias("rank_biserial"), "n1", "n2")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, dof, n, cramers_v of two category columns; nulls don't count."""
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = g.groupBy(a).agg(F.sum("n").alias("ra")), g.groupBy(b).agg(F.sum("n").alias("rb"))
    t = g.agg(F.sum("n").alias("t"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    # cells without rows add their expectation, which the sum over all cells makes up for
    j = g.join(ra, a).join(rb, b).crossJoin(F.broadcast(t))
    e = F.col("ra") * F.col("rb") / F.col("t")
    r = j.agg((F.sum((F.col("n") - e) * (F.col("n") - e) / e) + F.max("t") - F.sum(e)).alias("chi2"), F.max((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"), F.max("t").alias("n"), F.max(F.least("ka", "kb") - 1).alias("k"))
    return r.select("chi2", "dof", "n", F.sqrt(F.col("chi2") / F.nullif(F.col("n") * F.col("k"), F.lit(0))).alias("cramers_v"))


def average_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with `out`: the rank of x, ties sharing their mean; null stays null."""
    g = _ranked(df, F.col(x), F.lit(True)).select(F.col("x").alias("__x"), (F.col("ca") + (F.col("a") + 1) / 2).alias(out))
    return df.join(g, F.col(x).cast("double") == F.col("__x"), "left").drop("__x")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, n of rows with both values."""
    d = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_rank(average_rank(d, x, "__rx"), y, "__ry").agg(F.corr("__rx", "__ry").alias("rho"), F.count("*").alias("n"))


def spearman_bootstrap(df: DataFrame, x: str, y: str, key: list[str], draws: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: rho, low, high. Rows are drawn with replacement as Poisson counts made of
    a hash of their key and the draw; the ranks stay those of all rows. One aggregation
    by draw, for which no row leaves its task."""
    d = df.select(x, y, *[c for c in key if c not in (x, y)]).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_rank(average_rank(d, x, "__rx"), y, "__ry").withColumn("g", F.xxhash64(*key))
    u = (F.pmod(F.xxhash64("g", F.lit(seed), F.col("draw")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts = F.array(*[F.lit(float(c)) for c in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])])
    w = r.select("g", F.col("__rx").alias("a"), F.col("__ry").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("u", u)
    w = w.withColumn("w", F.size(F.filter(cuts, lambda c: c < F.col("u")))).where("w > 0")
    e = F.expr
    g = w.groupBy("draw").agg(*[F.sum(e(f"w * {t}")).alias(n) for n, t in {"n": "1D", "sa": "a", "sb": "b", "saa": "a * a", "sbb": "b * b", "sab": "a * b"}.items()])
    g = g.select(e("(sab - sa * sb / n) / nullif(sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)), 0)").alias("rho"))
    tail = (1 - level) / 2
    q = g.agg(F.percentile("rho", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return r.agg(F.corr("__rx", "__ry").alias("rho")).crossJoin(q).select("rho", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Confidence limits of a share."""
    p, d = hits / F.nullif(n, F.lit(0)), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    mid = (p + z * z / (2 * n)) / d
    return mid - half, mid + half


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Exact two-sided test: the probability of all outcomes no more likely than k."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in logs if x <= logs[k] + 1e-7))


def mantel_haenszel(df: DataFrame, stratum: list[str], exposed: Column, hit: Column) -> DataFrame:
    """One row: common odds ratio over strata, variance of its logarithm, CMH chi-square
    and the number of strata. One aggregation by stratum, one over strata."""
    n = lambda e, h: F.count(F.when(e & h, 1)).cast("double")
    g = df.where(exposed.isNotNull() & hit.isNotNull()).groupBy(*stratum).agg(n(exposed, hit).alias("a"), n(exposed, ~hit).alias("b"), n(~exposed, hit).alias("c"), n(~exposed, ~hit).alias("d"))
    t = F.expr("a + b + c + d")
    g = g.withColumn("t", t).where("t > 1")
    e = F.expr
    s = g.agg(
        F.sum(e("a * d / t")).alias("r"), F.sum(e("b * c / t")).alias("s"),
        F.sum(e("(a + d) / t * a * d / t")).alias("pr"), F.sum(e("(a + d) / t * b * c / t + (b + c) / t * a * d / t")).alias("ps"), F.sum(e("(b + c) / t * b * c / t")).alias("qs"),
        F.sum(e("a - (a + b) * (a + c) / t")).alias("dev"), F.sum(e("(a + b) * (c + d) * (a + c) * (b + d) / (t * t * (t - 1))")).alias("var"), F.count("*").alias("n_strata"),
    )
    return s.select(e("r / nullif(s, 0)").alias("odds_ratio"), e("pr / nullif(2 * r * r, 0) + ps / nullif(2 * r * s, 0) + qs / nullif(2 * s * s, 0)").alias("log_variance"), e("dev * dev / nullif(var, 0)").alias("cmh_chi2"), "n_strata")


def half_divergence(df: DataFrame, entity: str, order: list[str], category: str, least: int = 2) -> DataFrame:
    """entity, n, jsd: Jensen-Shannon divergence (base 2) of an entity's category shares
    between the first and the second half of its rows."""
    w = Window.partitionBy(entity)
    d = df.where(F.col(entity).isNotNull() & F.col(category).isNotNull())
    d = d.withColumn("__i", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= least)
    late = F.col("__i") > F.floor(F.col("__n") / 2)
    g = d.groupBy(entity, category).agg(F.count(F.when(~late, 1)).alias("a"), F.count(F.when(late, 1)).alias("b"))
    g = g.withColumn("p", F.col("a") / F.sum("a").over(w)).withColumn("q", F.col("b") / F.sum("b").over(w)).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    return g.groupBy(entity).agg(F.sum(F.col("a") + F.col("b")).alias("n"), (F.sum(part("p") + part("q")) / 2).alias("jsd"))


def group_sums(df: DataFrame, group: str, x: Column) -> DataFrame:
    """group, n, mean, ss: all that variance components and their bootstrap need."""
    v = df.select(F.col(group).alias("g"), x.cast("double").alias("x")).where("g is not null and x is not null")
    return v.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x") * (F.count("*") - 1), F.lit(0.0)).alias("ss"))


def icc_anova(sums: DataFrame) -> DataFrame:
    """One row: icc, n_groups, n_rows, from group_sums (or a resample of it): between and
    within mean squares with the mean group size, clipped to [0, 1]; null for fewer
    than two groups."""
    t = sums.agg(F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    s = sums.crossJoin(F.broadcast(t)).agg(F.max("k").alias("k"), F.max(F.col("grand")).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"), F.sum("ss").alias("ssw"))
    e = F.expr
    s = s.select("k", "n", e("ssb / greatest(k - 1, 1)").alias("msb"), e("ssw / greatest(n - k, 1)").alias("msw"), e("n / k").alias("size"))
    icc = F.when(F.col("k") >= 2, F.coalesce(F.least(F.greatest(e("(msb - msw) / nullif(msb + (size - 1) * msw, 0)"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    return s.select(icc.alias("icc"), F.col("k").alias("n_groups"), F.col("n").alias("n_rows"))


def icc_mixed(sums: DataFrame, level: float = 0.95) -> DataFrame:
    """One row: icc, low, high, n_groups, n_rows: the share of the groups' variance in a
    random-intercept model fitted by restricted maximum likelihood, from group_sums.

    Given the ratio of both variances, the likelihood needs four sums over groups. They
    are taken for a grid of ratios in one aggregation, and again for a finer grid around
    the best, eight times; the driver sees the grid's sums. The interval is that of the
    delta method, each variance with a standard error of sqrt(2 / degrees of freedom)
    times itself. Fewer than two groups, no spare row, or no variance at all give null."""
    sums = materialise(sums, "group-sums")
    t = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("ss"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")).first()
    ddl = "icc double, low double, high double, n_groups bigint, n_rows bigint"
    k, n = t["k"], t["n"] or 0
    if k < 2 or n <= k:
        return sums.sparkSession.createDataFrame([(None, None, None, k, n)], ddl)
    m = F.col("mean") - F.lit(t["grand"])

    def deviance(ratios: list[float]) -> list[tuple[float, float, float]]:
        """(deviance, ratio, residual variance) at each ratio."""
        aggs = []
        for i, r in enumerate(ratios):
            w = F.col("n") / (1 + F.col("n") * r)
            aggs += [F.sum(w).alias(f"w{i}"), F.sum(w * m).alias(f"m{i}"), F.sum(w * m * m).alias(f"q{i}"), F.sum(F.log1p(F.col("n") * r)).alias(f"l{i}")]
        s = sums.agg(*aggs).first()
        out = []
        for i, r in enumerate(ratios):
            w, a, q = s[f"w{i}"], s[f"m{i}"], s[f"q{i}"]
            residual = (t["ss"] + max(q - a * a / w, 0.0)) / (n - 1)
            if residual > 0:
                out.append(((n - 1) * math.log(residual) + s[f"l{i}"] + math.log(w), r, residual))
        return out

    low, high = -8.0, 8.0
    best = min(deviance([0.0]), default=None)
    for _ in range(8):
        grid = np.linspace(low, high, 25)
        best = min([*deviance([float(10**g) for g in grid]), *([best] if best else [])], default=None)
        if best is None or best[1] == 0:
            break
        step, centre = (high - low) / 24, math.log10(best[1])
        low, high = centre - step, centre + step
    if best is None:
        return sums.sparkSession.createDataFrame([(None, None, None, k, n)], ddl)
    between, within = best[1] * best[2], best[2]
    total = between + within
    icc = between / total
    error = math.hypot(within / total**2 * between * math.sqrt(2 / k), between / total**2 * within * math.sqrt(2 / (n - k)))
    z = NormalDist().inv_cdf((1 + level) / 2)
    discard(sums)
    return sums.sparkSession.createDataFrame([(icc, max(icc - z * error, 0.0), min(icc + z * error, 1.0), k, n)], ddl)


def icc_bootstrap(sums: DataFrame, draws: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: icc, low, high. Groups are drawn with replacement as Poisson counts made
    of a hash of group and draw, so that every draw is one weighted sum in the same
    single aggregation and no group is copied."""
    u = (F.pmod(F.xxhash64("g", F.lit(seed), F.col("draw")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts = F.array(*[F.lit(float(c)) for c in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])])
    drawn = sums.select("g", "n", "mean", "ss", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("u", u)
    drawn = drawn.withColumn("w", F.size(F.filter(cuts, lambda c: c < F.col("u")))).where("w > 0")
    w, n, m = F.col("w"), F.col("n"), F.col("mean")
    a = drawn.groupBy("draw").agg(F.sum(w).alias("k"), F.sum(w * n).alias("n"), F.sum(w * n * m).alias("s1"), F.sum(w * n * m * m).alias("s2"), F.sum(w * F.col("ss")).alias("ssw"))
    e = F.expr
    a = a.select(e("(s2 - s1 * s1 / n) / greatest(k - 1, 1)").alias("msb"), e("ssw / greatest(n - k, 1)").alias("msw"), e("n / k").alias("size"), "k").where("k >= 2")
    a = a.select(e("coalesce(least(greatest((msb - msw) / nullif(msb + (size - 1) * msw, 0), 0.0D), 1.0D), 0.0D)").alias("icc"))
    tail = (1 - level) / 2
    q = a.agg(F.percentile("icc", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return icc_anova(sums).select("icc").crossJoin(q).select("icc", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r for every two columns, in one aggregation; pairs with a null don't count."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def principal_components(df: DataFrame, columns: list[str]) -> DataFrame:
    """component, explained, loadings: of the standardised columns. The correlation
    matrix, columns by columns, is all that reaches the driver."""
    complete = df.dropna(subset=columns)
    r = {(x["x"], x["y"]): x["r"] for x in pearson_matrix(complete, columns).collect()}
    m = np.array([[1.0 if a == b else (r.get((a, b)) or r.get((b, a)) or 0.0) for b in columns] for a in columns])
    values, vectors = np.linalg.eigh(m)
    rows = []
    for i, k in enumerate(np.argsort(-values)):
        v = vectors[:, k] * (1 if vectors[np.abs(vectors[:, k]).argmax(), k] > 0 else -1)
        rows.append((i + 1, float(values[k] / values.sum()), [float(x) for x in v]))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, loadings array<double>")


def average_linkage_order(names: list[str], correlation: dict[tuple[str, str], float]) -> list[str]:
    """Columns ordered so that alike ones (by 1 - |r|) lie together: average linkage on a
    matrix of columns by columns."""
    clusters = [[n] for n in names]
    gap = lambda a, b: 1 - abs(correlation.get((a, b), correlation.get((b, a), 0.0)))
    while len(clusters) > 1:
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))), key=lambda x: np.mean([gap(a, b) for a in clusters[x[0]] for b in clusters[x[1]]]))
        clusters[i] += clusters.pop(j)
    return clusters[0]


def iqr_outliers(df: DataFrame, x: str, k: float = 1.5) -> DataFrame:
    """One row: low, high (fences at k interquartile ranges), n, n_low, n_high; the fences
    are null without a value."""
    q = exact_quantiles(df, F.col(x), [0.25, 0.75])
    low, high = (F.lit(v).cast("double") for v in ((q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) if q else (None, None)))
    one = df.agg(F.count(x).alias("n"), F.count(F.when(F.col(x) < low, 1)).alias("n_low"), F.count(F.when(F.col(x) > high, 1)).alias("n_high"))
    return one.select(low.alias("low"), high.alias("high"), "n", "n_low", "n_high")


def metric_rows(df: DataFrame, dataset: str, metric: str, value: str, digits: int = 4, **dims: str) -> DataFrame:
    """A flat metric table: dataset, metric, dims, value rounded, NaN made null."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.round(F.col(value).cast("double"), digits))
    return df.select(F.lit(dataset).alias("dataset"), F.lit(metric).alias("metric"), *[F.col(c).cast("string").alias(k) for k, c in dims.items()], v.alias("value"))
