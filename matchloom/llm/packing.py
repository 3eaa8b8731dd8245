"""Documents packed into containers of fixed capacity, by linear grouping.

Sizes are whole numbers up to the capacity, so everything about the sizes fits into a
histogram with one count per size, however many documents there are. The plan is made on
it: large sizes are split into groups of equal cardinality and rounded up to their
group's largest; configurations (which groups fill a container) are optimised by column
generation; then the actual sizes take the places of the rounded ones, and small sizes go
best fit into what is left. The result is a list of container classes, each with its
content by size and how many containers there are of it, which is at most a few thousand
lines. Documents are then numbered within their size, without any single task seeing all
documents of a size, and read their container off the plan.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.session import materialise

#: Fixed value: the pattern that the rank file's tokenizer splits text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = os.environ.get("MATCHLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Groups of large sizes; sizes above capacity / LARGE are large.
GROUPS, LARGE = 96, 8
#: Parts that the documents of one size are numbered in.
SALTS = 256


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have 0. Strings that look
    like special tokens are ordinary text. tokenizer: a rank file that every executor
    can read."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[doc_id, "n_tokens"])

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, n_tokens bigint")


def _best_configuration(value: np.ndarray, sizes: list[int], limit: list[int], capacity: int) -> tuple[float, tuple[int, ...]]:
    """The configuration worth most: a knapsack by capacity, each group at most `limit`
    times."""
    worth = np.zeros(capacity + 1)
    taken = []
    for v, s, most in zip(value, sizes, limit):
        best, count = worth.copy(), np.zeros(capacity + 1, np.int32)
        for k in range(1, min(most, capacity // s) + 1):
            other = np.full(capacity + 1, -1.0)
            other[k * s :] = worth[: capacity + 1 - k * s] + k * v
            better = other > best + 1e-12
            best[better], count[better] = other[better], k
        worth = best
        taken.append(count)
    room, out = capacity, [0] * len(sizes)
    for g in range(len(sizes) - 1, -1, -1):
        out[g] = int(taken[g][room])
        room -= out[g] * sizes[g]
    return float(worth[capacity]), tuple(out)


def optimise_configurations(sizes: list[int], demand: list[int], capacity: int) -> dict[tuple[int, ...], int]:
    """How often to use which configuration: the optimum of the linear programme, which
    wants the demand met with the fewest containers, by column generation, rounded down.
    What is then still wanted is less than one container per group.

    Generation ends when no configuration is worth more than a container, or when the
    value of the best one proves that less than half a container can still be saved.
    Prices that go round in a circle without a saving are an error."""
    n = len(sizes)
    columns = [tuple(min(capacity // sizes[g], demand[g]) if k == g else 0 for k in range(n)) for g in range(n)]
    basis = np.array(columns, float).T
    want = np.array(demand, float)
    use = np.linalg.solve(basis, want)
    seen: set[tuple] = set()
    while True:
        price = np.linalg.solve(basis.T, np.ones(n))
        worth, config = _best_configuration(np.maximum(price, 0), sizes, demand, capacity)
        # no plan needs fewer than use / worth containers
        if worth <= 1 + 1e-7 or use.sum() * (1 - 1 / worth) < 0.5:
            break
        step = np.linalg.solve(basis, np.array(config, float))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, use / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        use = use - ratio[out] * step
        use[out] = ratio[out]
        basis[:, out] = config
        columns[out] = config
        if ratio[out] > 1e-9:
            seen.clear()
        elif (state := tuple(sorted(columns))) in seen:
            raise RuntimeError("column generation goes round in a circle")
        else:
            seen.add(state)
    plan: Counter = Counter()
    left = list(demand)
    for config, x in sorted(zip(columns, use), reverse=True):
        times = int(min([x + 1e-9, *[left[g] // c for g, c in enumerate(config) if c]]))
        if times > 0:
            plan[config] += times
            left = [a - times * c for a, c in zip(left, config)]
    return dict(plan)


def pack_histogram(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: int = LARGE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Container classes [(containers, ((size, how many), ...))] for counts of items by
    size, 1 to capacity. Every item is placed, none is over capacity."""
    big = [(s, histogram[s]) for s in sorted(histogram) if s * large > capacity and histogram[s]]
    total = sum(n for _, n in big)
    # linear grouping: groups of equal cardinality, each rounded up to its largest size;
    # with few sizes each is a group of its own
    runs: list[list[tuple[int, int]]] = [[x] for x in big] if len(big) <= groups else []
    if total and not runs:
        each, room = -(-total // groups), 0
        for s, n in big:
            while n:
                if not room:
                    runs.append([])
                    room = each
                k = min(n, room)
                runs[-1].append((s, k))
                n, room = n - k, room - k
    if total:
        merged: dict[int, list[tuple[int, int]]] = {}
        for r in runs:
            merged.setdefault(r[-1][0], []).extend(r)
        tops = sorted(merged)
        plan = optimise_configurations(tops, [sum(n for _, n in merged[t]) for t in tops], capacity)
    # substitution: a configuration's places are filled from its groups in the order of size
    classes: Counter = Counter()
    if total:
        queue = {t: [list(x) for x in merged[t]] for t in tops}
        for config, times in sorted(plan.items(), reverse=True):
            while times:
                content: Counter = Counter()
                step, taken = times, []
                for t, c in zip(tops, config):
                    q, i, c_left = queue[t], 0, c
                    while c_left:  # from the front of the group, as many per container as needed
                        s, n = q[i]
                        if n >= c_left:
                            taken.append((t, i, c_left))
                            step = min(step, n // c_left)
                            content[s] += c_left
                            c_left = 0
                        else:
                            taken.append((t, i, n))
                            step = 1
                            content[s] += n
                            c_left -= n
                            i += 1
                for t, i, c in taken:
                    queue[t][i][1] -= c * step
                for t in {t for t, _, _ in taken}:
                    queue[t] = [x for x in queue[t] if x[1]]
                classes[tuple(sorted(content.items()))] += step
                times -= step
    # best fit of the rest, from the largest size down, into the fullest containers that have room
    rest = Counter({s: n for s, n in histogram.items() if s * large <= capacity and n})
    if total:
        for q in queue.values():
            for s, n in q:
                rest[s] += n
    by_room: dict[int, Counter] = defaultdict(Counter)
    for content, times in classes.items():
        by_room[capacity - sum(s * n for s, n in content)][content] += times
    rooms = sorted(by_room)

    def put(content, times: int) -> None:
        room = capacity - sum(s * n for s, n in content)
        if room not in by_room or not by_room[room]:
            i = bisect_left(rooms, room)
            if i == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        by_room[room][content] += times

    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            i = bisect_left(rooms, s)
            while i < len(rooms) and not by_room[rooms[i]]:
                del by_room[rooms[i]], rooms[i]
            if i == len(rooms):
                per = min(n, capacity // s)
                times = n // per
                put(((s, per),), times)
                n -= times * per
                continue
            room = rooms[i]
            content, times = next(iter(by_room[room].items()))
            per = min(n, room // s)
            k = min(times, n // per)
            if k == times:
                del by_room[room][content]
            else:
                by_room[room][content] -= k
            merged_content = Counter(dict(content))
            merged_content[s] += per
            put(tuple(sorted(merged_content.items())), k)
            n -= k * per
    return [(times, content) for r in sorted(by_room) for content, times in sorted(by_room[r].items()) if times]


def pack(sizes: DataFrame, capacity: int, item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(item, piece, size, container, start): where each item goes.

    sizes: one row per item. An item over capacity is cut into full containers' worth
    and a rest; others are never split. piece counts from 0, start is the offset within
    the item. An item of size 0 or null, which needs no room, gets container null; a
    repeated item is placed as often as it occurs."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if item in ("piece", "size", "container", "start", "salt"):
        raise ValueError(f"column {item} clashes with the result's")
    spark = sizes.sparkSession
    kind = sizes.schema[item].dataType.simpleString()
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int") - 1)
    p = sizes.select(F.col(item), n.alias("__n"), F.explode(pieces).alias("piece"))
    p = p.select(item, "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start"), F.least(F.col("__n") - F.col("piece") * F.lit(capacity).cast("bigint"), F.lit(capacity)).cast("int").alias("size"))
    p = materialise(p.withColumn("salt", F.pmod(F.xxhash64(item, "piece"), F.lit(SALTS)).cast("int")), "pieces")
    # numbers within a size: per part of a size, then the parts one after another
    per = materialise(p.groupBy("size", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r["size"]: r["n"] for r in per.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    lines, container, used = [], 0, Counter()
    for times, content in pack_histogram(histogram, capacity):
        for s, k in content:
            lines.append((s, used[s], used[s] + times * k, k, container))
            used[s] += times * k
        container += times
    if dict(used) != histogram:
        raise AssertionError("the plan doesn't place every piece")
    plan = spark.createDataFrame(lines, "size int, first bigint, until bigint, per int, container0 bigint")
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("size", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("size", "salt").orderBy(item, "piece"))
    p = p.withColumn("i", number).join(before, ["size", "salt"]).withColumn("i", F.col("before") + F.col("i") - 1)
    # a size's lines lie one after another: the piece is in the last one that begins at or before it.
    # The plan's size is bounded by the capacity, not by the documents.
    own = plan.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("first", "per", "container0"))).alias("lines"))
    j = p.join(F.broadcast(own), "size", "left")
    line = F.element_at(F.filter("lines", lambda x: x["first"] <= F.col("i")), -1)
    j = j.withColumn("line", F.when(F.col("lines").isNotNull(), line))
    return j.select(item, "piece", "size", (F.col("line.container0") + F.expr("(i - line.first) div line.per")).alias("container"), "start")
