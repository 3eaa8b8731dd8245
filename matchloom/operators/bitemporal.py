"""Attribute values as they were known at an event's time.

A version says: from `valid` on the value holds, and this was recorded at `known`. The
plane of valid time and recorded time of an entity is cut into disjoint rectangles, in
each of which one version is the current one. The rectangles are indexed by a grid of
valid-time cells, and each event point is located in the one rectangle that holds it.

Entities are cut into strips of valid time first, so that no task ever has to hold all
versions of a hot entity; what a strip takes over from earlier ones is a running maximum
over per-strip aggregates.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.session import materialise

#: Open end of recorded time.
FOREVER = 1 << 62
DAY = 86_400_000_000
#: Versions per grid cell that the grid aims at within a strip.
PER_CELL = 16
#: Rows up to which the table of finer grids is broadcast; a larger one is shuffled.
SMALL = 50_000

_RECT = "entity string, strip bigint, cells int, valid_from bigint, valid_to bigint, known_from bigint, known_to bigint, value double"


def _cells(versions: int) -> int:
    """Grid cells of a strip with so many versions: a power of two, 1 for few."""
    return 1 << max(0, (versions // PER_CELL).bit_length())


def _sweep(width: int, diagonal: bool):
    """Cuts each strip's plane into rectangles, going through it by recorded time.

    The state is the strip's known versions in the order of valid time, each with the
    recorded time from which its current rectangle is open. A newly recorded version
    closes its predecessor's rectangle (which goes on as a narrower one) or, if it
    restates the same valid time, replaces it. That is at most two rectangles a
    version. With `diagonal`, points have known = valid + 1: rectangles are cut down to
    what the diagonal can touch, and those off it are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, own, at, val, opened = None, 0, [], [], []

        def emit(i: int, until: int, cells: int, lo: int, hi: int) -> None:
            a = max(at[i], lo, opened[i] - 1) if diagonal else max(at[i], lo)
            b = min(at[i + 1] if i + 1 < len(at) else hi, hi, until - 1)  # points lie at known > valid
            if a < b and opened[i] < until:
                out.append((key[0], key[1], cells, a, b, opened[i], until, val[i]))

        def close() -> None:
            nonlocal own, at, val, opened
            if key is not None:
                lo = key[1] * width
                for i in range(len(at)):
                    emit(i, FOREVER, 0, lo, lo + width)
                n = _cells(own)
                for k in range(done, len(out)):
                    out[k] = (*out[k][:2], n, *out[k][3:])
            own, at, val, opened = 0, [], [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 8
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            names = ["entity", "strip", "cells", "valid_from", "valid_to", "known_from", "known_to", "value"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        done = 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for entity, strip, k, v, value, mine in zip(*cols):
                if key != (entity, strip):
                    close()
                    done = len(out)
                    if done >= 20_000:
                        yield flush()
                        out.clear()
                        done = 0
                    key = (entity, strip)
                own += mine
                lo = strip * width
                i = bisect_left(at, v)
                if i < len(at) and at[i] == v:  # restated: the one known last holds
                    emit(i, k, 0, lo, lo + width)
                    val[i], opened[i] = value, k
                    continue
                if i:
                    emit(i - 1, k, 0, lo, lo + width)
                    opened[i - 1] = k
                at.insert(i, v)
                val.insert(i, value)
                opened.insert(i, k)
        close()
        yield flush()

    return run


def current_rectangles(versions: DataFrame, strips: DataFrame, width: int, diagonal: bool = False) -> DataFrame:
    """Disjoint rectangles of `versions` (entity, valid, known, value) in valid and
    recorded time, both half open, within strips of `width` microseconds. `strips`
    (entity, strip) lists the strips that will be asked for."""
    v, k = F.col("valid"), F.col("known")
    first = F.floor(v / F.lit(width))  # the strip that valid lies in
    own = versions.select("entity", first.alias("strip"), "known", "valid", "value", F.lit(1).alias("own"))
    # recorded after the start of a later strip: such a strip takes it up when it becomes known.
    # With `diagonal` a strip's points ask for what is known within the strip, so that of the
    # strips before the one it was recorded in none takes it up.
    last = F.ceil(k / F.lit(width)) - 1
    late = versions.where(last > first)
    if diagonal:
        late = late.withColumn("strip", last)
    else:
        span = strips.groupBy("entity").agg(F.min("strip").alias("lo"), F.max("strip").alias("hi"))
        late = late.join(span, "entity").withColumn("a", F.greatest(first + 1, F.col("lo"))).withColumn("b", F.least(last, F.col("hi"))).where("a <= b")
        late = late.withColumn("strip", F.explode(F.sequence("a", "b")))
    # known by the start of a strip: only the latest valid one matters
    start = F.greatest(first + 1, F.ceil(k / F.lit(width)))
    best = versions.groupBy("entity", start.alias("strip")).agg(F.max(F.struct("valid", "known", "value")).alias("b"))
    asked = strips.select("entity", "strip").distinct().withColumn("asked", F.lit(True))
    order = Window.partitionBy("entity").orderBy("strip")
    base = (
        best.join(asked, ["entity", "strip"], "full")
        .withColumn("b", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("asked") & F.col("b").isNotNull())
        .select("entity", "strip", F.col("b.known").alias("known"), F.col("b.valid").alias("valid"), F.col("b.value").alias("value"), F.lit(0).alias("own"))
    )
    late = late.join(asked.drop("asked"), ["entity", "strip"], "left_semi").select("entity", "strip", "known", "valid", "value", F.lit(0).alias("own"))
    rows = own.unionByName(late).unionByName(base)
    rows = rows.repartition("entity", "strip").sortWithinPartitions("entity", "strip", "known", "valid", "value")
    return rows.mapInArrow(_sweep(width, diagonal), _RECT)


def as_known_at(
    points: DataFrame,
    versions: DataFrame,
    entity: list[str],
    at: Column,
    valid: Column,
    known: Column,
    value: Column,
    known_at: Column | None = None,
    strip_days: int = 28,
    out: str = "value",
) -> DataFrame:
    """`points` with `out`: the value of the version with the latest valid time strictly
    before `at` among those known at or before `known_at` (by default `at` itself; it
    must not be earlier). Of versions with the same valid time the one known last
    holds; should they be known at the same time too, the larger value.

    at, valid, known and known_at are timestamps, value is a number. entity names the
    columns, alike in both tables, that identify an entity; null matches nothing.
    Versions with a null anywhere count as absent. Points without a version, or with a
    null `at`, get null; every row of points is kept once, repeated rows too. Columns of
    `points` may have any names but `out`, which is replaced."""
    width = strip_days * DAY
    name = F.when(F.array_contains(F.array(*[F.col(e).isNull() for e in entity]), True), F.lit(None)).otherwise(F.concat_ws("\x1f", *[F.col(e).cast("string") for e in entity]))
    vs = versions.select(name.alias("entity"), F.unix_micros(valid).alias("valid"), F.when(known.isNotNull(), F.greatest(F.unix_micros(known), F.unix_micros(valid) + 1)).alias("known"), value.cast("double").alias("value"))
    vs = vs.where("entity is not null and valid is not null and known is not null and value is not null")
    columns = [c for c in points.columns if c != out]
    ps = points.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        name.alias("entity"),
        (F.unix_micros(at) - 1).alias("t"),  # strictly before: valid <= at - 1
        F.unix_micros(at if known_at is None else known_at).alias("tau"),
    ).withColumn("strip", F.floor(F.col("t") / F.lit(width)))
    rects = current_rectangles(vs, ps.where("entity is not null and strip is not null"), width, known_at is None)
    # strips with many versions have a finer grid
    fine = vs.groupBy("entity", F.floor(F.col("valid") / F.lit(width)).alias("strip")).agg(F.count("*").alias("n")).where(F.col("n") >= PER_CELL)
    bits = F.length(F.bin(F.expr(f"n div {PER_CELL}")))
    fine = materialise(fine.select("entity", "strip", F.pow(F.lit(2.0), bits).cast("int").alias("cells")), "fine-grids")
    fine = F.broadcast(fine) if fine.count() <= SMALL else fine
    cell = lambda x, cells: F.floor((x - F.col("strip") * width) * cells / width).cast("int")
    ps = ps.join(fine, ["entity", "strip"], "left").withColumn("cell", cell(F.col("t"), F.coalesce("cells", F.lit(1)))).drop("cells")
    rects = rects.withColumn("cell", F.explode(F.sequence(cell(F.col("valid_from"), F.col("cells")), cell(F.col("valid_to") - 1, F.col("cells")))))
    rects = rects.select(F.col("entity").alias("e"), F.col("strip").alias("s"), F.col("cell").alias("c"), "valid_from", "valid_to", "known_from", "known_to", F.col("value").alias("found"))
    inside = (F.col("entity") == F.col("e")) & (F.col("strip") == F.col("s")) & (F.col("cell") == F.col("c"))
    inside &= (F.col("valid_from") <= F.col("t")) & (F.col("t") < F.col("valid_to")) & (F.col("known_from") <= F.col("tau")) & (F.col("tau") < F.col("known_to"))
    return ps.join(rects, inside, "left").select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("found").alias(out))
