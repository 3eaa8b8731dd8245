import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matchloom.functions import scalar as S
from matchloom.operators import relational as R
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def frames(spark, seed=1):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(hours=r.randrange(0, 3000))
    left = [(i, r.choice([1, 1, 1, 2, 7, None]), at() if i % 17 else None) for i in range(200)]
    right = [(r.choice([1, 1, 2, 3, None]), at() if i % 13 else None, r.randrange(50) if i % 11 else None) for i in range(200)]
    return left, right, spark.createDataFrame(left, "i int, k int, at timestamp"), spark.createDataFrame(right, "k int, at timestamp, v int")


@pytest.mark.parametrize("direction,cell_days", [("backward", 28), ("forward", 28), ("backward", 0.5), ("forward", 0.5)])
def test_asof(spark, direction, cell_days):
    left, right, l, r = frames(spark)
    want = []
    for i, k, t in left:
        ok = [(a, v) for kk, a, v in right if None not in (kk, a, v, k, t) and kk == k and (a <= t if direction == "backward" else a > t)]
        best = None
        if ok:
            near = max(a for a, _ in ok) if direction == "backward" else min(a for a, _ in ok)
            best = max(v for a, v in ok if a == near)
        want.append((i, k, t, best))
    got = R.asof_join(l, r, "k", "at", "at", "v", direction, "v", cell_days)
    assert rows(got) == sorted(want, key=str)
    assert R.asof_join(l, r.limit(0), "k", "at", "at", "v").where("asof_value is not null").count() == 0
    assert R.asof_join(l.limit(0), r, "k", "at", "at", "v").count() == 0


@pytest.mark.parametrize("before", [False, True])
def test_interval_join(spark, before):
    left, right, l, r = frames(spark, 2)
    secs = 36 * 3600
    low = -secs if before else 0
    want = [(i, k, t, a, v) for i, k, t in left for kk, a, v in right if k is not None and k == kk and t is not None and a is not None and low <= (a - t).total_seconds() <= secs]
    r = r.withColumnRenamed("at", "other")
    assert rows(R.interval_join(l, r, "k", "at", "other", secs, before=before)) == sorted(want, key=str)
    outer = R.interval_join(l, r, "k", "at", "other", secs, "left", before)
    met = {w[0] for w in want}
    want += [(i, k, t, None, None) for i, k, t in left if i not in met and t is not None]
    assert rows(outer.where("at is not null")) == sorted(want, key=str)


def test_keep_first_top_and_mode(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "z"), (None, 5, "w"), (None, 4, None)], "k string, n int, s string")
    got = R.keep_first(df, ["k"], [F.col("n").isNull(), F.col("n"), F.col("s")])
    assert rows(got) == sorted([("a", 1, "y"), ("b", None, "z"), (None, 4, None)], key=str)
    assert R.top_per_group(df, ["k"], [F.desc_nulls_last("n"), F.col("s")], 2).count() == 5
    assert rows(R.mode_per_group(df, ["k"], "s")) == sorted([("a", "y", 2), ("b", "z", 1), (None, "w", 1)], key=str)
    assert R.keep_first(df.limit(0), ["k"], [F.col("n")]).count() == 0


def test_shares_grid_gaps_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "y")], "g string, v string")
    assert sum(r["share"] for r in R.shares(df, ["g"]).collect()) == pytest.approx(1)
    assert rows(R.dense_grid(df, "g", "v")) == [("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]
    d = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 4),), (None,)], "t timestamp")
    assert [str(r[0]) for r in R.calendar_gaps(d, "t").orderBy("missing").collect()] == ["2024-01-02", "2024-01-03"]
    assert R.calendar_gaps(d.limit(0), "t").count() == 0
    p = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, "c")], "m int, x string")
    assert rows(R.unordered_pairs(p, "m", "x")) == [(1, "a", "b")]
    assert rows(R.one_sided(p, p.where("m = 1"), ["m"])) == [(2, "a")]


def test_samples_repeat(spark):
    df = spark.range(1000).withColumn("e", F.col("id") % 50)
    assert rows(R.hash_sample(df, ["id"], 10)) == rows(R.hash_sample(df.repartition(7), ["id"], 10))
    picked = R.entity_sample(df, "e", 0.3)
    assert picked.count() == 20 * picked.select("e").distinct().count()
    assert R.stratified_groups(df, "e", 20, strata=4).select("e").distinct().count() == 20
    everyone = df.select("e").distinct().count()
    assert R.stratified_groups(df, "e", 10_000, strata=4).count() == everyone
    assert rows(R.table_fingerprint(df)) == rows(R.table_fingerprint(df.orderBy(F.desc("id"))))


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert [one(S.round_half_even_long(F.lit(x))) for x in (2.5, 3.5, 2.7, -2.5)] == [2, 4, 3, -2]
    assert one(S.month_boundaries(F.lit("2024-01-31").cast("date"), F.lit("2024-03-01").cast("date"))) == 2
    assert one(S.quarter_label(F.lit("2024-05-01").cast("date"))) == "2024-Q2"
    assert one(S.file_pattern(F.lit("rating-2024-01-02_0123456789abcdef01_17.csv"))) == "rating-{date}_{hash}_{N}.csv"
    assert one(S.relative_name(F.lit("file:///a/b/c/d.csv"), "/a/b")) == "c/d.csv"
    assert one(S.log10_bin(F.lit(0.0))) is None and one(S.gap_bucket(F.lit(None).cast("double"))) == "first"
    assert one(S.pair_key(F.lit(5), F.lit(3))) == one(S.pair_key(F.lit(3), F.lit(5)))
    few = spark.createDataFrame([(1.0,), (2.0,)], "x double").agg(S.skewness_adjusted(F.col("x")).alias("s"), S.kurtosis_adjusted(F.col("x")).alias("k")).first()
    assert few["s"] is None and few["k"] is None


@pytest.mark.parametrize("width", [5, 1000])
def test_lag_in_cells(spark, width):
    r = random.Random(3)
    data = [(i, r.choice([1, 1, 2, None]), r.randrange(60) if i % 9 else None, r.choice("xyz")) for i in range(150)]
    got = R.lag_in_cells(spark.createDataFrame(data, "i int, k int, at int, s string"), ["k"], F.col("at"), [F.col("i")], {"prev": F.col("s"), "prev_i": F.col("i")}, width)
    last, want = {}, []
    for i, k, at, s in sorted(data, key=lambda d: (d[2] is None, d[2] or 0, d[0])):
        p = last.get(k, (None, None))
        want.append((i, k, at, s, *p))
        last[k] = (s, i)
    assert rows(got) == sorted(want, key=str)
