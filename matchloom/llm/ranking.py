"""One global ranking from pairwise comparisons, by iterative Luce spectral ranking.

Comparisons are a flow: from each loser to its winner runs a transition whose rate is the
number of such results divided by the sum of both strengths. With the rates fixed, the
chain's stationary distribution is solved for; the rates are rebuilt from it, until the
distribution that the rates are built from is itself stationary. That is where the
likelihood is greatest.

Players lie in chunks of bounded size, results in blocks between two chunks, as arrays; a
block with many results is several rows, so that a hub's results are spread over tasks
whichever side it is on. A balance step (inflow over outflow rate) goes over the blocks
once, sums up within the task, and shuffles one pair of arrays a chunk and task. Anderson
mixing, which needs only small matrices of inner products on the driver, speeds up both
the solving and the rebuilding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import discard, materialise

#: Players of a chunk, and results of a block's row, aimed at.
CHUNK, BLOCK = 1 << 16, 1 << 16
#: Chunks up to which all strengths are broadcast (16 bytes a player); beyond they are shuffled.
BROADCAST_CHUNKS = 32
#: Rows of arrays that Python takes at a time.
ROWS_AT_A_TIME = 4
#: A solved distribution's imbalance is at most this share of how far it has moved.
SOLVED = 0.5

_ARRAY, _ARRAYS = pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))
_STATE = "chunk int, z array<double>, y array<double>, xs array<array<double>>, fs array<array<double>>, zs array<array<double>>, gs array<array<double>>, imbalance double, moved double, inner array<double>, outer array<double>"
_STATE_TYPES = [pa.int32(), _ARRAY, _ARRAY, _ARRAYS, _ARRAYS, _ARRAYS, _ARRAYS, pa.float64(), pa.float64(), _ARRAY, _ARRAY]


def comparison_pairs(wins: DataFrame, winner: str = "winner", loser: str = "loser") -> DataFrame:
    """(lo, hi, lo_won, hi_won) for each two players that met, from rows that each state
    one winner and one loser. Rows with a null, or of a player against itself, don't count."""
    w = wins.select(F.col(winner).alias("w"), F.col(loser).alias("l")).where("w is not null and l is not null and w <> l")
    w = w.groupBy(F.least("w", "l").alias("lo"), F.greatest("w", "l").alias("hi"))
    return w.agg(F.sum(F.when(F.col("w") < F.col("l"), 1.0).otherwise(0.0)).alias("lo_won"), F.sum(F.when(F.col("w") > F.col("l"), 1.0).otherwise(0.0)).alias("hi_won"))


def _floats(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)


def _mix(points: list[np.ndarray], steps: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """Anderson's next point, from the last points and the steps taken at them."""
    out = points[0] + steps[0]
    for k, w in enumerate(weights):
        out = out - w * (points[k] - points[k + 1] + steps[k] - steps[k + 1])
    return out


def _gram(steps: list[np.ndarray]) -> list[float]:
    """Inner products of the differences of successive steps, and with the last step."""
    d = [steps[k] - steps[k + 1] for k in range(len(steps) - 1)]
    return [float(a @ b) for i, a in enumerate(d) for b in d[i:]] + [float(a @ steps[0]) for a in d]


def _weights(gram: list[float]) -> list[float]:
    """The mixture of steps with the least length, from the sums of all chunks' products."""
    m = int((np.sqrt(9 + 8 * len(gram)) - 3) / 2 + 0.5)
    if not m:
        return []
    g, at = np.zeros((m, m)), 0
    for i in range(m):
        for k in range(i, m):
            g[i, k] = g[k, i] = gram[at]
            at += 1
    return np.linalg.lstsq(g + 1e-10 * np.trace(g) * np.eye(m), np.array(gram[at:]), rcond=None)[0].tolist()


def _turn(b: pa.RecordBatch, r: int, order: tuple) -> tuple:
    """(z, y, xs, fs, zs, gs) of a chunk after the driver's order: 'solve' with weights
    goes on under the same rates, 'rebuild' with weights takes new ones."""
    z, y = _floats(b, "z", r), _floats(b, "y", r)
    xs, fs, zs, gs = ([v.values.to_numpy(zero_copy_only=False) for v in b.column(c)[r]] for c in ("xs", "fs", "zs", "gs"))
    kind, weights = order
    if kind == "solve":
        return z, _mix(xs, fs, weights), xs, fs, zs, gs
    if kind == "rebuild":
        z = _mix(zs, gs, weights)
        return z, z, [], [], zs, gs
    return z, y, [], [], [], []


def _strengths(order: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(b.column("chunk")[r].as_py(), *_turn(b, r, order)[:2]) for r in range(b.num_rows)]
            yield _batch(rows, [pa.int32(), _ARRAY, _ARRAY], ["chunk", "z", "y"])

    return run


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' inflow and outflow rate to each player, summed up within the task."""
    sums: dict[int, list[np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        out = _batch([(c, i, o) for c, (i, o) in sums.items()], [pa.int32(), _ARRAY, _ARRAY], ["chunk", "inflow", "outflow"])
        sums.clear()
        return out

    for t in batches:
        for r in range(t.num_rows):
            i, j, won, lost = (_floats(t, c, r) for c in ("i", "j", "won", "lost"))
            za, ya, zb, yb = (_floats(t, c, r) for c in ("za", "ya", "zb", "yb"))
            rate = 1.0 / (np.exp(za)[i] + np.exp(zb)[j])
            won, lost = won * rate, lost * rate
            for c, inflow, outflow in (
                (t.column("a")[r].as_py(), np.bincount(i, won * np.exp(yb)[j], len(za)), np.bincount(i, lost, len(za))),
                (t.column("b")[r].as_py(), np.bincount(j, lost * np.exp(ya)[i], len(zb)), np.bincount(j, won, len(zb))),
            ):
                if c in sums:
                    sums[c][0] += inflow
                    sums[c][1] += outflow
                else:
                    sums[c] = [inflow, outflow]
        if len(sums) > BROADCAST_CHUNKS:
            yield flush()
    yield flush()


def _balance(order: tuple, prior: float, memory: int):
    """A balance step of each chunk: rows of its flows, and its state's row last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflow = outflow = None
        for b in batches:
            out = []
            for r in range(b.num_rows):
                if not b.column("is_state")[r].as_py():
                    i, o = _floats(b, "inflow", r), _floats(b, "outflow", r)
                    inflow, outflow = (i.copy(), o.copy()) if inflow is None else (inflow + i, outflow + o)
                    continue
                z, y, xs, fs, zs, gs = _turn(b, r, order)
                if inflow is None:
                    inflow, outflow = np.zeros(len(z)), np.zeros(len(z))
                virtual = prior / (1.0 + np.exp(z))
                up, down = inflow + virtual, outflow + virtual
                live = (up > 0) & (down > 0)
                f = np.where(live, np.log(np.where(live, up, 1) / np.where(live, down, 1)) - y, 0.0)
                if not xs:  # rates are new: what they are built from joins the history of rebuilds
                    zs, gs = [z, *zs][: memory + 1], [np.zeros(len(z)), *gs][: memory + 1]
                xs, fs = [y, *xs][: memory + 1], [f, *fs][: memory + 1]
                gs[0] = y + f - z
                out.append((b.column("chunk")[r].as_py(), z, y, xs, fs, zs, gs, float(np.abs(f).max(initial=0)), float(np.abs(gs[0]).max(initial=0)), _gram(fs), _gram(gs)))
                inflow = outflow = None
            yield _batch(out, _STATE_TYPES, [x.split()[0] for x in _STATE.split(", ")])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The players of a block's results as their places in the chunks."""
    for b in batches:
        rows = []
        for r in range(b.num_rows):
            at = [dict(zip(ids, range(len(ids)))) for ids in (b.column("ids_a")[r].as_py(), b.column("ids_b")[r].as_py())]
            cells = b.column("results")[r].values
            i, j = ([at[k][p] for p in cells.field(c).to_pylist()] for k, c in enumerate(("lo", "hi")))
            rows.append((b.column("a")[r].as_py(), b.column("b")[r].as_py(), i, j, cells.field("lo_won").to_pylist(), cells.field("hi_won").to_pylist()))
        yield _batch(rows, [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), _ARRAY, _ARRAY], ["a", "b", "i", "j", "won", "lost"])


def _with_chunks(blocks: DataFrame, chunks: DataFrame, columns: list[str], n_chunks: int) -> DataFrame:
    """Each block's row with `columns` of its two chunks, as <column>a and <column>b."""
    small = F.broadcast if n_chunks <= BROADCAST_CHUNKS else lambda df: df
    for side in ("a", "b"):
        blocks = blocks.join(small(chunks.select(F.col("chunk").alias(side), *[F.col(c).alias(c + side) for c in columns])), side)
    return blocks


def _reached(blocks: DataFrame, chunks: DataFrame, start, forward: bool, n_chunks: int) -> DataFrame:
    """(chunk, r): for each player whether a chain of results leads to it from `start`;
    forward: each beats the one before it, else each loses to it."""
    up, down = ("won", "lost") if forward else ("lost", "won")
    state = materialise(chunks.select("chunk", F.transform("ids", lambda p: F.when(p == F.lit(start), 1.0).otherwise(0.0)).alias("r")), "reached")
    count = 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for t in batches:
            for k in range(t.num_rows):
                i, j, ra, rb = (_floats(t, c, k) for c in ("i", "j", "ra", "rb"))
                for c, n in ((t.column("a")[k].as_py(), np.bincount(i, (_floats(t, up, k) > 0) * rb[j], len(ra))), (t.column("b")[k].as_py(), np.bincount(j, (_floats(t, down, k) > 0) * ra[i], len(rb)))):
                    sums[c] = np.maximum(sums[c], n > 0) if c in sums else (n > 0).astype(float)
            if len(sums) > BROADCAST_CHUNKS:
                yield _batch(list(sums.items()), [pa.int32(), _ARRAY], ["chunk", "r"])
                sums.clear()
        yield _batch(list(sums.items()), [pa.int32(), _ARRAY], ["chunk", "r"])

    while True:
        new = _with_chunks(blocks, state, ["r"], n_chunks).mapInArrow(spread, "chunk int, r array<double>").unionByName(state)
        new = new.select("chunk", F.posexplode("r").alias("at", "v")).groupBy("chunk", "at").agg(F.max("v").alias("v"))
        new = new.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("r"))
        new, old = materialise(new, "reached"), state
        discard(old)
        state, before = new, count
        count = int(state.select(F.sum(F.aggregate("r", F.lit(0.0), lambda a, x: a + x))).first()[0])
        if count == before:
            return state


def luce_strengths(wins: DataFrame, winner: str = "winner", loser: str = "loser", prior: float = 0.0, tolerance: float = 1e-5, memory: int = 5, most_steps: int = 1000) -> DataFrame:
    """(player, strength, status, n_comparisons, n_won) for every player of `wins`;
    strength is a logarithm: with a prior 0 is the strength of the virtual player, without
    one the mean of all finite strengths.

    The exact maximum of the likelihood (prior 0) exists among players who are all joined
    by chains of wins in both directions. It is taken over those who are so joined to the
    player with the most comparisons (status 'ranked'). Others have no finite strength:
    'above' (infinity) if chains of wins lead only to them, 'below' (minus infinity) if
    only from them, 'apart' (null) if none do. prior: wins and losses that each player
    has, beside its own, against a virtual player; with one, every player is ranked.

    tolerance: the largest imbalance, as a change of log strength, at which rates are
    those of their own stationary distribution; if most_steps balance steps are not enough
    it is an error. Repeated rows count as often as they occur. No rows give an empty
    result. Ids may be of any type that has an order."""
    spark = wins.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    pairs = materialise(comparison_pairs(wins, winner, loser), "pairs")
    side = lambda p, won, lost: F.struct(F.col(p).alias("player"), F.col(won).alias("won"), F.col(lost).alias("lost"))
    players = pairs.select(F.inline(F.array(side("lo", "lo_won", "hi_won"), side("hi", "hi_won", "lo_won"))))
    players = materialise(players.groupBy("player").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost")), "players")
    n = players.count()
    shape = T.StructType([T.StructField("player", players.schema["player"].dataType)])
    if not n:
        return spark.createDataFrame([], shape).select("player", *[F.lit(None).cast(t).alias(c) for c, t in (("strength", "double"), ("status", "string"), ("n_comparisons", "bigint"), ("n_won", "bigint"))])
    n_chunks = -(-n // CHUNK)
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(n_chunks)).cast("int")
    chunks = players.groupBy(chunk("player").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("player", "won", "lost"))).alias("p"))
    chunks = materialise(chunks.select("chunk", F.col("p.player").alias("ids"), F.col("p.won").alias("won"), F.col("p.lost").alias("lost")), "chunks")
    rows = pairs.select(chunk("lo").alias("a"), chunk("hi").alias("b"), "lo", "hi", "lo_won", "hi_won")
    parts = rows.groupBy("a", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(parts, ["a", "b"]).withColumn("part", F.pmod(F.xxhash64("lo", "hi"), F.col("parts")))
    rows = rows.groupBy("a", "b", "part").agg(F.collect_list(F.struct("lo", "hi", "lo_won", "hi_won")).alias("results"))
    spark.conf.set(setting, ROWS_AT_A_TIME)
    try:
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = _with_chunks(rows, chunks, ["ids"], n_chunks).withColumnsRenamed({"idsa": "ids_a", "idsb": "ids_b"})
        blocks = materialise(blocks.repartition(shuffled, "a", "b", "part").mapInArrow(_index, "a int, b int, i array<int>, j array<int>, won array<double>, lost array<double>"), "blocks")
        ranked = chunks.select("chunk", F.transform("ids", lambda p: F.lit("ranked")).alias("status"))
        kept = []
        live = blocks
        if not prior:
            start = players.orderBy(F.desc(F.col("won") + F.col("lost")), "player").first()["player"]
            up, down = (_reached(blocks, chunks, start, forward, n_chunks) for forward in (True, False))
            both = up.join(down.withColumnRenamed("r", "d"), "chunk")
            status = F.zip_with("r", "d", lambda u, v: F.when((u > 0) & (v > 0), "ranked").when(u > 0, "above").when(v > 0, "below").otherwise("apart"))
            ranked = materialise(both.select("chunk", status.alias("status")), "status")
            core = ranked.select("chunk", F.transform("status", lambda s: (s == "ranked").cast("double")).alias("r"))
            inside = _with_chunks(blocks, core, ["r"], n_chunks)
            mask = lambda c: F.zip_with(c, F.zip_with("i", "j", lambda x, y: F.col("ra")[x] * F.col("rb")[y]), lambda v, m: v * m).alias(c)
            live = materialise(inside.select("a", "b", "i", "j", mask("won"), mask("lost")), "blocks")
            kept += [up, down, live]
        zero, none = F.transform("ids", lambda p: F.lit(0.0)), F.array().cast("array<array<double>>")
        state = chunks.select("chunk", zero.alias("z"), zero.alias("y"), *[none.alias(c) for c in ("xs", "fs", "zs", "gs")])
        state = materialise(state, "strengths")
        order: tuple = ("begin", [])
        for _ in range(most_steps):
            sent = state.mapInArrow(_strengths(order), "chunk int, z array<double>, y array<double>")
            flows = _with_chunks(live, sent, ["z", "y"], n_chunks).mapInArrow(_flows, "chunk int, inflow array<double>, outflow array<double>")
            both = flows.withColumn("is_state", F.lit(False)).unionByName(state.select("chunk", "z", "y", "xs", "fs", "zs", "gs", F.lit(True).alias("is_state")), allowMissingColumns=True)
            both = both.repartition("chunk").sortWithinPartitions("chunk", "is_state")
            new, old = materialise(both.mapInArrow(_balance(order, prior, memory), _STATE), "strengths"), state
            discard(old)
            state = new
            # sums of a few numbers for each chunk of players
            sums = state.select("imbalance", "moved", "inner", "outer").collect()
            imbalance, moved = (max(r[c] for r in sums) for c in ("imbalance", "moved"))
            if order[0] != "solve" and imbalance < tolerance:
                break
            kind, column = ("rebuild", "outer") if imbalance <= max(SOLVED * moved, tolerance / 10) else ("solve", "inner")
            order = (kind, _weights(np.sum([r[column] for r in sums], axis=0).tolist()))
        else:
            raise RuntimeError(f"no stationary strengths after {most_steps} balance steps")
    finally:
        spark.conf.set(setting, before)
    for t in (pairs, players, blocks, *kept):
        discard(t)
    out = state.select("chunk", F.zip_with("y", F.col("fs")[0], lambda a, b: a + b).alias("strength")).join(chunks, "chunk").join(ranked, "chunk")
    out = out.select(F.inline(F.arrays_zip(F.col("ids").alias("player"), "strength", "status", "won", "lost")))
    strength = F.when(F.col("status") == "ranked", F.col("strength")).when(F.col("status") == "above", F.lit(float("inf"))).when(F.col("status") == "below", F.lit(float("-inf")))
    if not prior:
        finite = out.where("status = 'ranked'").agg(F.avg("strength").alias("centre"))
        out = out.crossJoin(F.broadcast(finite)).withColumn("strength", F.col("strength") - F.coalesce("centre", F.lit(0.0)))
    return out.select("player", strength.alias("strength"), "status", (F.col("won") + F.col("lost")).cast("bigint").alias("n_comparisons"), F.col("won").cast("bigint").alias("n_won"))
