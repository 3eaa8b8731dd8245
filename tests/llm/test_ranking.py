import numpy as np
import pytest

from matchloom.llm import ranking
from matchloom.llm.ranking import luce_strengths


def exact(wins, prior, rounds=20000):
    """Plain maximum-likelihood iteration (minorise-maximise) with a virtual player of strength 1."""
    ids = sorted({p for w in wins for p in w})
    at = {p: i for i, p in enumerate(ids)}
    n = np.zeros((len(ids), len(ids)))
    for w, l in wins:
        n[at[w], at[l]] += 1
    pi = np.ones(len(ids))
    games = n + n.T
    for _ in range(rounds):
        new = (n.sum(1) + prior) / ((games / (pi[:, None] + pi[None, :])).sum(1) + 2 * prior / (1 + pi))
        if np.abs(np.log(new / pi)).max() < 1e-12:
            break
        pi = new
    return dict(zip(ids, np.log(pi)))


def run(spark, wins, **options):
    df = spark.createDataFrame(wins, "winner int, loser int")
    return {r["player"]: r for r in luce_strengths(df, **options).collect()}


def test_maximum_likelihood(spark):
    rng = np.random.default_rng(5)
    true = rng.normal(0, 1.2, 25)
    wins = []
    for _ in range(400):
        a, b = rng.choice(25, 2, replace=False, p=np.arange(1, 26) / np.arange(1, 26).sum())
        wins.append((int(a), int(b)) if rng.random() < 1 / (1 + np.exp(true[b] - true[a])) else (int(b), int(a)))
    want, got = exact(wins, 0.5), run(spark, wins, prior=0.5, tolerance=1e-7)
    assert set(got) == set(want)
    assert max(abs(got[p]["strength"] - want[p]) for p in want) < 1e-4
    assert sum(r["n_won"] for r in got.values()) == 400 and sum(r["n_comparisons"] for r in got.values()) == 800


def test_parts_unbeaten_nulls_and_repeats(spark):
    wins = [(1, 2)] * 3 + [(2, 3), (3, 2), (10, 11), (11, 10), (10, 11), (None, 1), (1, None), (5, 5)]
    want, got = exact([w for w in wins if None not in w and w[0] != w[1]], 0.5), run(spark, wins, prior=0.5)
    assert set(got) == {1, 2, 3, 10, 11}
    assert all(abs(got[p]["strength"] - want[p]) < 1e-3 for p in want)
    assert got[1]["n_won"] == 3 and got[1]["n_comparisons"] == 3


@pytest.mark.parametrize("most", [1 << 16, 7])
def test_hub_in_many_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "CHUNK", most)
    monkeypatch.setattr(ranking, "BLOCK", most)
    monkeypatch.setattr(ranking, "BROADCAST_CHUNKS", 4)
    wins = [(0, i) if i % 3 else (i, 0) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)]
    want, got = exact(wins, 0.5), run(spark, wins, prior=0.5, tolerance=1e-6)
    assert max(abs(got[p]["strength"] - want[p]) for p in want) < 1e-3


def test_exact_maximum_and_where_there_is_none(spark):
    """Without a prior: the plain maximum among players joined both ways, and no finite
    strength for those above (10, 11), below (20) and apart (30, 31)."""
    core = [(1, 2), (2, 3), (3, 1), (1, 2), (2, 1), (3, 4), (4, 3), (4, 1), (1, 4), (1, 3)]
    wins = [*core, (10, 1), (10, 2), (11, 10), (3, 20), (30, 31)]
    got = run(spark, wins, tolerance=1e-8)
    want = exact(core, 0.0)
    mean = sum(want.values()) / len(want)
    assert all(abs(got[p]["strength"] - want[p] + mean) < 1e-5 and got[p]["status"] == "ranked" for p in want)
    assert {p: got[p]["status"] for p in (10, 11, 20, 30, 31)} == {10: "above", 11: "above", 20: "below", 30: "apart", 31: "apart"}
    assert got[10]["strength"] == float("inf") and got[20]["strength"] == float("-inf") and got[30]["strength"] is None


def test_ids_of_other_types(spark):
    wins = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")]
    df = spark.createDataFrame(wins, "winner string, loser string")
    got = {r["player"]: r["strength"] for r in luce_strengths(df, tolerance=1e-8).collect()}
    want = exact(wins, 0.0)
    assert all(abs(got[p] - got["a"] - want[p] + want["a"]) < 1e-5 for p in want)


def test_empty(spark):
    assert run(spark, []) == {}
