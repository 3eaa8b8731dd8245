"""Relational operators: keep-first, top-k, shares, as-of, interval and grid joins.

Unless stated otherwise null keys match nothing in joins and are a group of their own in
aggregations, repeated rows count as often as they occur, and empty inputs give empty
results. Helper columns begin with two underscores; input columns must not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`, which should break all ties.

    It is an aggregation (minimum of a row that begins with the order), which combines
    before the shuffle; a window would move and sort every row of a hot key."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.select(*keys, F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest]).alias("__r"))
    return ranked.groupBy(*keys).agg(F.min("__r").alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows per group and task before
    the shuffle (window group limit), so a hot group doesn't travel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def mode_per_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the most frequent value of each group, the smaller one of ties;
    null values don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))
    return n.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def shares(df: DataFrame, keys: list[str], within: list[str] = ()) -> DataFrame:
    """keys, n, share: each group's part of all rows, or of its `within` group. The window
    runs over the counts, not over the rows; the total of all is a one-row aggregate."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if within:
        return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    total = n.agg(F.sum("n").alias("__total"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def counts_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_groups: how many groups have how many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("n_groups"))


def dense_grid(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: counts for every combination of the values of two category columns, 0
    where there is no row. For columns with few values: the grid is their product."""
    have = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    grid = have.select(a).distinct().crossJoin(have.select(b).distinct())
    return grid.join(have, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def asof_join(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, value: str, direction: str = "backward", out: str = "asof_value", cell_days: float = 28) -> DataFrame:
    """`left` with the value of the nearest right row: at or before (backward), or
    strictly after (forward). Of right rows at the same time the larger value counts.

    No range join, whose pairs would be quadratic in a key's rows: a union with a running
    window. Time is cut into cells, and the window runs within (key, cell), so that a hot
    key is many tasks' work; what a cell takes over from earlier (later) ones comes from
    an aggregate with one row per cell. Left rows without match, or with a null key or
    time, have null. A column named like `out` is replaced."""
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back, width = direction == "backward", int(cell_days * 86_400_000_000)
    columns = [c for c in left.columns if c != out]
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("__t")
    cell = F.floor(F.col("__t") / width)
    r = right.where(F.col(on).isNotNull() & F.col(right_at).isNotNull() & F.col(value).isNotNull()).select(F.col(on).alias("__k"), t(right_at), F.col(value).alias("__v"))
    null_row = F.lit(None).cast(left.select(F.struct(*columns).alias("s")).schema["s"].dataType)
    l = left.select(F.col(on).alias("__k"), t(left_at), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*columns).alias("__row"), F.lit(1).alias("__left"))
    both = l.unionByName(r.select("*", null_row.alias("__row"), F.lit(0).alias("__left"))).withColumn("__c", cell)
    # of each cell the right row nearest to the cells that follow in the direction
    nearest = F.max(F.struct("__t", "__v"))["__v"] if back else F.max(F.struct((-F.col("__t")).alias("__t"), "__v"))["__v"]
    over = Window.partitionBy("__k").orderBy("__c" if back else F.desc("__c"))
    asked = l.where("__k is not null and __t is not null").select("__k", cell.alias("__c")).distinct()
    carry = r.withColumn("__c", cell).groupBy("__k", "__c").agg(nearest.alias("__n")).unionByName(asked.withColumn("__n", F.lit(None).cast(right.schema[value].dataType)))
    carry = carry.groupBy("__k", "__c").agg(F.max("__n").alias("__n")).withColumn("__carry", F.last("__n", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    # right rows at a left row's time come before it backward, and after it forward; of their ties the larger is last
    order = [F.asc("__t"), F.asc("__left"), F.asc("__v")] if back else [F.desc("__t"), F.desc("__left"), F.asc("__v")]
    w = Window.partitionBy("__k", "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__found", F.last("__v", ignorenulls=True).over(w)).where("__left = 1")
    both = both.join(carry, ["__k", "__c"], "left")
    found = F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.coalesce("__found", "__carry"))
    return both.select(*[F.col("__row").getField(c).alias(c) for c in columns], found.alias(out))


def lag_in_cells(df: DataFrame, keys: list[str], at: Column, ties: list[Column], columns: dict[str, Column], width: int) -> DataFrame:
    """df with, for each name of `columns`, that expression's value in the previous row of
    the key by (`at`, `ties`); null in a key's first row.

    at is a number (a tick, or microseconds). It is cut into cells of `width`, and lag
    runs within (key, cell), so that a hot key is many tasks' work; a cell's first row
    takes its values from an aggregate with one row per cell. Rows with a null `at` come
    last, in a cell of their own. Null keys are a key. ties should leave no two rows
    alike; the values must be of types that can be ordered."""
    names = list(columns)
    k = {f"__k{i}": F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for i, c in enumerate(keys)}
    order = [F.coalesce(at.cast("double"), F.lit(float("inf"))).alias("o"), *[t.alias(f"t{i}") for i, t in enumerate(ties)]]
    d = df.withColumns(k | {"__c": F.coalesce(F.floor(at / width).cast("bigint"), F.lit((1 << 62))), "__o": F.struct(*order), "__v": F.struct(*[c.alias(n) for n, c in columns.items()])})
    w = Window.partitionBy(*k, "__c").orderBy("__o")
    d = d.withColumn("__prev", F.lag("__v").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    ends = d.groupBy(*k, "__c").agg(F.max_by("__v", "__o").alias("__end"))
    ends = ends.select(*k, "__c", F.lag("__end").over(Window.partitionBy(*k).orderBy("__c")).alias("__before"))
    d = d.join(ends, [*k, "__c"], "left").withColumn("__prev", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__prev")))
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col("__prev").getField(n).alias(n) for n in names])


def interval_join(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, seconds: int, how: str = "inner", before: bool = False) -> DataFrame:
    """Pairs of one key whose right time lies from the left time to `seconds` later (with
    `before` also that much earlier), ends included.

    Times are put into cells as wide as the interval, and a left row goes to the two (or
    three) cells that it can reach: an equality join on (key, cell) instead of a
    comparison of all rows of a key. how: inner or left. The right side's columns must
    differ in name from the left's, but for the key."""
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    r = right.select(F.col(on).alias("__k"), F.floor(secs(right_at) / width).alias("__c"), *[F.col(c) for c in right.columns if c != on])
    l = left.withColumn("__id", F.monotonically_increasing_id()) if how == "left" else left
    cell = F.floor(secs(left_at) / width)
    first = cell - 1 if before else cell
    reach = l.withColumn("__c1", F.explode(F.sequence(first, cell + 1)))
    low = secs(left_at) - width if before else secs(left_at)
    cond = (F.col(on) == F.col("__k")) & (F.col("__c1") == F.col("__c")) & secs(right_at).between(low, secs(left_at) + width)
    pairs = reach.join(r, cond, "inner").drop("__k", "__c", "__c1")
    if how == "inner":
        return pairs
    extra = [c for c in right.columns if c != on]
    # every left row once more, and kept only where it met nothing
    met = reach.join(r, cond, "left").drop("__k", "__c", "__c1")
    some = F.max(F.col(extra[0]).isNotNull() if len(extra) == 1 else F.col(right_at).isNotNull()).over(Window.partitionBy("__id"))
    n = F.row_number().over(Window.partitionBy("__id").orderBy(F.col(right_at).asc_nulls_last()))
    met = met.withColumn("__some", some).withColumn("__n", n)
    return met.where((F.col("__some") & F.col(right_at).isNotNull()) | (~F.col("__some") & (F.col("__n") == 1))).drop("__id", "__some", "__n")


def unordered_pairs(df: DataFrame, key: str, item: str) -> DataFrame:
    """key, a, b with a < b: the distinct pairs of items that share a key, for keys that
    are small by nature, such as the rows of one match."""
    d = df.select(key, item).where(F.col(item).isNotNull()).distinct()
    return d.withColumnRenamed(item, "a").join(d.withColumnRenamed(item, "b"), key).where("a < b")


def calendar_gaps(df: DataFrame, at: str, unit: str = "day") -> DataFrame:
    """missing: the days or months between the first and last time without any row. The
    calendar is generated from one row of bounds."""
    day = F.to_date(at)
    d = df.where(F.col(at).isNotNull()).select((F.trunc(day, "month") if unit == "month" else day).alias("t")).distinct()
    span = d.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null")
    step = F.expr("interval 1 month") if unit == "month" else F.expr("interval 1 day")
    return span.select(F.explode(F.sequence("a", "b", step)).alias("t")).join(d, "t", "left_anti").select(F.col("t").alias("missing"))


def one_sided(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """on, side: keys in only one of two tables ('a' or 'b')."""
    x, y = a.select(*on).distinct(), b.select(*on).distinct()
    return x.join(y, on, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, on, "left_anti").withColumn("side", F.lit("b")))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones in every run: those with the smallest seeded hash of `keys`."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def entity_sample(df: DataFrame, entity: str, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of about `fraction` of the entities; no shuffle, as the hash decides."""
    return df.where(F.pmod(F.xxhash64(F.col(entity), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def stratified_groups(df: DataFrame, entity: str, n: int, strata: int = 10, seed: int = 42) -> DataFrame:
    """entity, n_rows, stratum: n entities (all if there are fewer), alike many from each
    stratum of group size; strata are cut at size quantiles. What strata with fewer
    entities leave open is topped up from the others, what rounding has too many is
    trimmed, both in the order of a hash."""
    sizes = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n_rows"))
    cuts = sizes.agg(F.array_distinct(F.percentile("n_rows", F.array(*[F.lit(i / strata) for i in range(1, strata)]))).alias("cuts"))
    s = sizes.crossJoin(F.broadcast(cuts)).withColumn("stratum", F.size(F.filter("cuts", lambda c: c < F.col("n_rows")))).drop("cuts")
    s = s.withColumn("__h", F.xxhash64(entity, F.lit(seed)))
    w = Window.partitionBy("stratum").orderBy("__h", entity)
    s = s.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)  # no stratum gives more
    each = s.agg(F.greatest(F.floor(F.lit(n) / F.countDistinct("stratum")), F.lit(1)).alias("__e"))
    s = s.crossJoin(F.broadcast(each)).orderBy(F.col("__n") > F.col("__e"), "__h", entity).limit(n)
    return s.select(entity, "n_rows", "stratum")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """n_rows, fingerprint: of the rows in any order; nothing is concatenated. Repeated
    rows count."""
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))
