"""Event logs: (file, loop, type, JSON text), one row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.operators.relational import lag_in_cells


def event_profile(df: DataFrame, file: str, kind: str) -> DataFrame:
    """kind, n, share, n_files, coverage, per_file: how often a type occurs, in how many
    files, and how often in those. Counted by (type, file) first."""
    g = df.groupBy(kind, file).agg(F.count("*").alias("n"))
    files = df.agg(F.countDistinct(file).alias("files"), F.count("*").alias("rows"))
    by = g.groupBy(kind).agg(F.sum("n").alias("n"), F.count(file).alias("n_files"))
    return by.crossJoin(F.broadcast(files)).select(kind, "n", (F.col("n") / F.col("rows")).alias("share"), "n_files", (F.col("n_files") / F.nullif(F.col("files"), F.lit(0))).alias("coverage"), (F.col("n") / F.nullif(F.col("n_files"), F.lit(0))).alias("per_file"))


def tick_gaps(df: DataFrame, file: str, loop: str, keys: list[str] = (), width: int = 1 << 14) -> DataFrame:
    """gap, n: distances between successive events of a file (and key)."""
    t = F.col(loop)
    d = lag_in_cells(df.select(file, *keys, loop), [file, *keys], t, [], {"__p": t}, width)
    return d.select((t - F.col("__p")).alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def tick_histogram(df: DataFrame, kind: str, loop: str, width: int = 1000) -> DataFrame:
    return df.groupBy(kind, (F.floor(F.col(loop) / width) * width).alias("tick")).agg(F.count("*").alias("n"))


def json_keys_by_type(df: DataFrame, kind: str, text: str, order: list[Column], first: int | None = None) -> DataFrame:
    """kind, keys: the names that events of a type have at the top level, of all events,
    or of each type's first so many. Broken JSON counts as having none."""
    if first is not None:
        w = Window.partitionBy(kind).orderBy(*order)
        df = df.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= first)
    k = df.select(kind, F.explode_outer(F.json_object_keys(text)).alias("k")).distinct()
    return k.groupBy(kind).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keys"))


def attribute_events(events: DataFrame, players: DataFrame, file: str, kind: str, text: str, paths: dict[str, list[str]], player: str) -> DataFrame:
    """events with `player` (from the JSON paths that the event's type has it under, in
    this order) and is_known, whether the file's players include it; slot is player,
    neutral (0) or none."""
    at: Column = F.lit(None).cast("int")
    for k, ps in paths.items():
        found = F.coalesce(*[F.get_json_object(text, p).try_cast("int") for p in ps])
        at = F.when(F.col(kind) == k, found).otherwise(at)
    have = players.select(F.col(file).alias("__f"), F.col(player).alias("__p")).where("__p is not null").distinct().withColumn("__known", F.lit(True))
    e = events.withColumn(player, at)
    e = e.join(have, (F.col(file) == F.col("__f")) & (F.col(player) == F.col("__p")), "left").drop("__f", "__p")
    slot = F.when(F.col(player).isNull(), "none").when(F.col(player) == 0, "neutral").otherwise("player")
    return e.withColumn("is_known", F.coalesce("__known", F.lit(False))).withColumn("slot", slot).drop("__known")


def field_monotonicity(df: DataFrame, keys: list[str], loop: str, text: str, fields: dict[str, str], width: int = 1 << 14) -> DataFrame:
    """field, n, n_null, n_down, low, high: for JSON fields, how often a value falls from
    one event to the next (events at the same tick in the order of their text). All
    fields in one scan and one window."""
    m = range(len(fields))
    v = df.select(*keys, loop, text, *[F.get_json_object(text, p).try_cast("double").alias(f"v{i}") for i, p in enumerate(fields.values())])
    v = lag_in_cells(v, keys, F.col(loop), [F.col(text)], {f"p{i}": F.col(f"v{i}") for i in m}, width)
    one = v.agg(*[x for i in m for x in (F.count(f"v{i}").alias(f"n{i}"), F.count(F.when(F.col(f"v{i}").isNull(), 1)).alias(f"z{i}"), F.count(F.when(F.col(f"v{i}") < F.col(f"p{i}"), 1)).alias(f"d{i}"), F.min(f"v{i}").alias(f"l{i}"), F.max(f"v{i}").alias(f"h{i}"))])
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"n{i}").alias("n"), F.col(f"z{i}").alias("n_null"), F.col(f"d{i}").alias("n_down"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, n in enumerate(fields)]
    return one.select(F.inline(F.array(*rows)))


def lifecycle(df: DataFrame, keys: list[str], loop: str, born: Column, died: Column) -> DataFrame:
    """One row per entity: first_born, first_died and state: alive, dead, same_tick,
    inverted (died before it was born) or unborn (died only). One aggregation instead of
    joining births to deaths."""
    g = df.groupBy(*keys).agg(F.min(F.when(born, F.col(loop))).alias("first_born"), F.min(F.when(died, F.col(loop))).alias("first_died"))
    b, d = F.col("first_born"), F.col("first_died")
    state = F.when(b.isNull() & d.isNull(), None).when(b.isNull(), "unborn").when(d.isNull(), "alive").when(d < b, "inverted").when(d == b, "same_tick").otherwise("dead")
    return g.withColumn("state", state).where("state is not null")
