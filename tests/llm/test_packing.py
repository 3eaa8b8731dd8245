import random

import pytest

from matchloom.llm.packing import optimise_configurations, pack, pack_histogram, token_counts


@pytest.mark.parametrize("seed,capacity,n", [(1, 2048, 3000), (2, 50, 400), (3, 10, 200), (4, 1, 7), (5, 100, 1)])
def test_histogram_plan(seed, capacity, n):
    r = random.Random(seed)
    sizes = [min(capacity, max(1, int(r.lognormvariate(4.5, 1.3)) if capacity > 100 else r.randrange(1, capacity + 1))) for _ in range(n)]
    h = {s: sizes.count(s) for s in set(sizes)}
    plan, used = pack_histogram(h, capacity), {}
    for times, content in plan:
        assert sum(s * k for s, k in content) <= capacity
        for s, k in content:
            used[s] = used.get(s, 0) + times * k
    assert used == h
    room: list[int] = []  # first fit, decreasing
    for s in sorted(sizes, reverse=True):
        i = next((i for i, x in enumerate(room) if x >= s), None)
        if i is None:
            room.append(capacity - s)
        else:
            room[i] -= s
    assert sum(t for t, _ in plan) <= 1.02 * len(room) + 1


def test_configurations_keep_to_demand():
    plan = optimise_configurations([3, 4, 7], [30, 20, 10], 10)
    for config in plan:
        assert 3 * config[0] + 4 * config[1] + 7 * config[2] <= 10
    assert [sum(c[g] * n for c, n in plan.items()) for g in range(3)] == [30, 20, 10]
    assert sum(plan.values()) == 25  # ten 3+7, ten 3+3+4, five 4+4


def rows(spark, sizes, capacity):
    return pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint"), capacity).collect()


def test_every_piece_once_and_never_over(spark):
    r = random.Random(8)
    sizes = [r.randrange(1, 90) for _ in range(500)] + [7] * 400 + [0, None, 100, 101, 250, 1000]
    out = rows(spark, sizes, 100)
    load, pieces = {}, {}
    for x in out:
        pieces.setdefault(x["doc_id"], []).append((x["piece"], x["start"], x["size"]))
        if x["container"] is None:
            assert x["size"] == 0
        else:
            load[x["container"]] = load.get(x["container"], 0) + x["size"]
    assert max(load.values()) <= 100 and set(load) == set(range(len(load)))
    for i, s in enumerate(sizes):
        p = sorted(pieces[i])
        assert sum(x[2] for x in p) == (s or 0) and [x[1] for x in p] == [100 * k for k in range(len(p))]
        assert len(p) == max(1, -(-(s or 0) // 100))
    assert len(load) <= 1.03 * sum(s or 0 for s in sizes) / 100 + 2


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 60), (1, 60), (1, 60)], "doc_id bigint, n_tokens bigint")
    assert sorted(r["container"] for r in pack(df, 100).collect()) == [0, 1, 2]
    assert pack(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        pack(df, 0)


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "word " * 20_000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert n[1] == 3 and n[2] == n[3] == 0 and n[4] >= 20_000 and n[5] > 1
