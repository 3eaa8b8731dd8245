import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import audit as A
from matchloom.operators import event_log as E
from matchloom.operators import features as X
from matchloom.operators import pairs as P
from matchloom.operators import panel as N
from matchloom.operators import stats as T
from matchloom.sources import sinks
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def duels(spark):
    d = [(1, "a", 1, "x"), (1, "b", 0, None), (2, "a", 1, "x"), (2, "b", 1, "y"), (3, "c", 0, "x"), (4, "a", 0, "z"), (4, "c", 1, "z"), (4, "c", 1, "z"), (5, "a", 1, "x"), (5, "b", None, "x"), (None, "a", 1, "x"), (6, "a", 1, "x"), (6, "b", 0, "x"), (6, "c", 0, "x")]
    return spark.createDataFrame(d, "m int, p string, won int, civ string")


def test_symmetric_views_agree(spark, duels):
    a = P.symmetric_by_join(duels, "m", "p", "won", ["civ"])
    b = P.symmetric_by_aggregation(duels, "m", "p", "won", ["civ"])
    assert rows(a) == rows(b.select(*a.columns)) == sorted([(1, "a", "b", True, "x", None), (1, "b", "a", False, None, "x"), (4, "a", "c", False, "z", "z"), (4, "c", "a", True, "z", "z")], key=str)
    assert tuple(P.symmetry_violations(b, "m", "p", ["civ"]).first()) == (4, 2, 0)
    broken = b.withColumn("civ", F.when(F.col("p") == "a", F.lit("q")).otherwise(F.col("civ")))
    assert P.symmetry_violations(broken, "m", "p", ["civ"]).first()["n_violations"] == 2
    slots = P.slot_balance(P.canonical_slots(b, "m", "p"), "m").first()
    assert (slots["n_matches"], slots["n_bad"]) == (2, 0)
    assert P.symmetry_violations(b.limit(0), "m", "p", ["civ"]).first()["n_violations"] == 0


def test_slots_are_balanced(spark):
    v = spark.range(4000).select(F.col("id").alias("m"), F.inline(F.array(F.struct(F.lit("a").alias("p"), F.lit("b").alias("opponent"), F.lit(True).alias("won")), F.struct(F.lit("b").alias("p"), F.lit("a").alias("opponent"), F.lit(False).alias("won")))))
    s = P.slot_balance(P.canonical_slots(v, "m", "p"), "m").first()
    assert s["n_bad"] == 0 and 0.45 < s["share_won"] < 0.55


def test_census_by_type(spark):
    from pyspark.sql import Row

    data = [(1, "x", 0.0, True, T0, ["a"], Row(key="k", val=1)), (2, None, 1.5, False, None, [], Row(key=None, val=2)), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "id int, name string, score double, is_active boolean, created_at timestamp, tags array<string>, metadata struct<key:string,val:int>")
    c = {r["column_name"]: r for r in A.column_census(df).collect()}
    assert (c["score"]["n_zero"], c["score"]["zero_pct"], c["score"]["null_pct"]) == (1, 50.0, 33.3333)
    assert (c["tags"]["len_min"], c["tags"]["len_max"], c["tags"]["len_avg"]) == (0, 1, 0.5)
    assert c["metadata"]["n_distinct"] is None and c["name"]["n_distinct"] == 1 and c["created_at"]["low"].startswith("2024")
    assert A.column_census(df.limit(0)).where("n_rows = 0 and null_pct is null").count() == 7
    assert {r["column_name"]: r["n_distinct"] for r in A.leaf_census(df).collect()}["metadata.val"] == 2
    top = rows(A.frequent_values(df, ["name"], 2))
    assert top == [("name", 1, None, 2, 66.6667), ("name", 2, "x", 1, 33.3333)]
    assert rows(A.frequent_values(df, ["name"], 2, rarest=True)) == [("name", 1, "x", 1, 100.0)]


def test_ledger(spark):
    df = spark.createDataFrame([(i, None if i < 2 else i, "unknown" if i in (0, 1) else "t", True, None if i == 3 else i) for i in range(5)], "id int, score int, tag string, flag boolean, result int")
    spec = {"tag": {"sentinel": ["unknown"], "mechanism": "MNAR"}, "absent": {"sentinel": [1]}}
    led = {r["column_name"]: r for r in A.missingness_ledger(df, "v", spec, identity=["id"], target=["result"]).collect()}
    assert led["id"]["recommendation"] == "RETAIN_AS_IS" and led["id"]["n_distinct"] is None
    assert led["flag"]["recommendation"] == "DROP_COLUMN" and led["result"]["recommendation"] == "EXCLUDE_TARGET_NULL_ROWS"
    assert (led["tag"]["n_sentinel"], led["tag"]["pct_sentinel"], led["tag"]["recommendation"]) == (2, 40.0, "FLAG_FOR_IMPUTATION")
    assert led["score"]["pct_null"] == 40.0 and led["score"]["mechanism"] == "MAR"
    cases = [((3, 0, 1, "MAR", False), "CONVERT_SENTINEL_TO_NULL"), ((0, 0, 0, "MAR", False), "RETAIN_AS_IS"), ((81, 1, 0, "MAR", True), "DROP_COLUMN"), ((50, 1, 0, "MNAR", True), "DROP_COLUMN"), ((50, 1, 0, "MAR", True), "FLAG_FOR_IMPUTATION"), ((50, 1, 0, "MAR", False), "DROP_COLUMN"), ((6, 1, 0, "MCAR", False), "FLAG_FOR_IMPUTATION"), ((4, 1, 0, "MAR", False), "RETAIN_AS_IS")]
    assert all(A.recommend(*a) == want for a, want in cases)
    assert A.missingness_ledger(df.limit(0), "v").count() == 5


def test_gates(spark, duels):
    t = spark.createDataFrame([(T0,), (None,), (T0 + timedelta(days=40),)], "t timestamp")
    g = A.time_window_gate(t, "t", "2024-01-01", "2024-02-01").first()
    assert (g["n_after"], g["n_null"], g["passed"]) == (1, 1, False)
    assert A.time_window_gate(t.limit(1), "t", "2024-01-01", "2024-02-01").first()["passed"]
    r = A.referential_checks(duels, duels.where("m <= 3"), "m", "m").first()
    assert (r["n_child_orphans"], r["n_parent_childless"], r["n_child_null"]) == (8, 0, 1)
    assert rows(A.column_absence_gate(duels, ["won", "zzz"])) == [("won", True), ("zzz", False)]


def test_panel(spark):
    df = spark.createDataFrame([("a", "p1"), ("a", "p1"), ("b", "p1"), ("a", "p2"), (None, "p2"), ("c", None)], "e string, p string")
    f = N.with_churn(N.fraction_active(df, "e", F.col("p")))
    assert rows(f.select("period", "n_active", "n_ever", "churn")) == [("p1", 2, 2, 0.0), ("p2", 1, 2, 0.0)]
    o = spark.createDataFrame([("n", "x", 1), ("n", "x", 5), ("n", "y", 2), ("n", "y", 3), ("n", "z", 9)], "s string, e string, at int")
    assert {(r["entity_a"], r["entity_b"]): r["class"] for r in N.overlap_classes(o, "s", "e", "at").collect()} == {("x", "y"): "C", ("x", "z"): "A", ("y", "z"): "A"}


def sample(spark, n=300, seed=3):
    r = random.Random(seed)
    data = [(i, r.choice("abcdefgh"), r.choice("abcdefgh"), T0 + timedelta(hours=r.randrange(0, 900)), r.random() < 0.5, r.choice(["u", "v", None])) for i in range(n)]
    data = [d for d in data if d[1] != d[2]] + [(9001, "a", "b", None, True, "u"), (9002, None, "b", T0, True, "u"), (9003, "a", "b", T0 + timedelta(days=3), None, "u")]
    return data, spark.createDataFrame(data, "i int, p string, o string, at timestamp, won boolean, civ string")


@pytest.mark.parametrize("cell_days", [28, 1])
def test_history_is_strictly_past(spark, cell_days):
    data, df = sample(spark)
    got = {r["i"]: r for r in X.history_features(df, "p", "at", "won", ["civ"], cell_days).collect()}
    for i, p, _, at, _, civ in data:
        g = got[i]
        if p is None or at is None:
            assert g["n_prior"] is None and g["prior_win_rate"] is None
            continue
        past = [d for d in data if d[1] == p and d[3] is not None and d[3] < at]
        known = [d[4] for d in past if d[4] is not None]
        assert g["n_prior"] == len(past) and g["n_prior_civ"] == sum(d[5] == civ for d in past)
        assert g["prior_win_rate"] == (pytest.approx(sum(known) / len(known)) if known else None)
        assert (g["days_since_prior"] is None) == (not past)
        if past:
            assert g["days_since_prior"] == pytest.approx((at - max(d[3] for d in past)).total_seconds() / 86400)
    h = {r["i"]: r for r in X.head_to_head(df, "p", "o", "at", "won", cell_days).collect()}
    for i, p, o, at, _, _ in data:
        if p is not None and at is not None:
            assert h[i]["n_meetings"] == sum(d[1] == p and d[2] == o and d[3] is not None and d[3] < at for d in data)
    ok = df.where("p is not null and at is not null")
    assert X.leak_check(X.history_features(ok, "p", "at", "won"), ok, "p", "at", "n_prior").first()["n_leaks"] == 0
    leaky = X.history_features(ok, "p", "at", "won").withColumn("n_prior", F.col("n_prior") + 1)
    assert X.leak_check(leaky, ok, "p", "at", "n_prior").first()["n_leaks"] == ok.count()


def test_periodic_ratings(spark):
    import pandas as pd

    r = random.Random(6)
    data = [(r.choice("abcde"), r.choice("fghij"), r.randrange(5)) for _ in range(120)]
    got = {(x["entity"], x["period"]): x["rating"] for x in X.periodic_ratings(spark.createDataFrame(data, "w string, l string, p int"), "w", "l", "p", k=20.0, start=1000.0).collect()}
    want = X.replay_ratings(pd.DataFrame(data, columns=["w", "l", "p"]), 20.0, 1000.0)
    last = {e: max(p for x, p in got if x == e) for e in want}
    assert all(got[e, last[e]] == pytest.approx(want[e]) for e in want)
    assert X.periodic_ratings(spark.createDataFrame([], "w string, l string, p int"), "w", "l", "p", k=20.0, start=1000.0).count() == 0


def test_psi(spark):
    r = np.random.default_rng(1)
    a = spark.createDataFrame([(float(x),) for x in r.normal(1000, 100, 1000)], "x double")
    b = spark.createDataFrame([(float(x),) for x in r.normal(1200, 100, 1000)], "x double")
    assert T.feature_psi(a, a, "x").first()["psi"] == pytest.approx(0)
    assert T.feature_psi(a, b, "x").first()["psi"] > 1
    with pytest.raises(ValueError):
        T.quantile_edges(a.limit(5), F.col("x"))
    assert T.psi(a.limit(0).withColumn("b", F.lit(1)), b.withColumn("b", F.lit(1)), "b").first()["psi"] is None
    c, d = spark.createDataFrame([("u",), ("v",)], "x string"), spark.createDataFrame([("u",), ("w",)], "x string")
    assert T.feature_psi(c, d, "x", skip_unseen=True).first()["n_unseen"] == 1
    assert rows(T.frozen_category(d, "x", c).select("category")) == [("__unseen__",), ("u",)]
    edges = [0.0, 1.0, 2.0]
    bins = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, 5.0, None)], "x double")
    assert [r[0] for r in bins.select(T.frozen_bin(F.col("x"), edges)).collect()] == [0, 0, 0, 1, 1, 0]
    assert [r[0] for r in bins.select(T.frozen_bin(F.col("x"), edges, "left")).collect()] == [0, 0, 1, 1, 1, None]


def test_variance_components(spark):
    r = np.random.default_rng(2)
    data = [(g, float(5 * g + e)) for g in range(40) for e in r.normal(0, 1, 12)]
    sums = T.group_sums(spark.createDataFrame(data, "g int, x double"), "g", F.col("x"))
    x = np.array([v for _, v in data]).reshape(40, 12)
    msb, msw = 12 * x.mean(1).var(ddof=1), x.var(axis=1, ddof=1).mean()
    want = (msb - msw) / (msb + 11 * msw)
    b = T.icc_bootstrap(sums, draws=60).first()
    assert b["icc"] == pytest.approx(want) and b["low"] <= want <= b["high"]
    assert T.icc_anova(sums.limit(1)).first()["icc"] is None
    assert T.binomial_two_sided(5, 10) == pytest.approx(1.0) and T.binomial_two_sided(0, 10) == pytest.approx(2 / 1024)
    assert T.average_linkage_order(["a", "b", "c"], {("a", "c"): 0.9, ("a", "b"): 0.1, ("b", "c"): 0.2})[:2] == ["a", "c"]


def test_rank_tests(spark):
    r = random.Random(9)
    data = [(float(r.randrange(12)), r.random() < 0.4) for _ in range(200)] + [(None, True), (1.0, None)]
    df = spark.createDataFrame(data, "x double, f boolean")
    a = [x for x, f in data if f and x is not None]
    b = [x for x, f in data if f is False]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert T.mann_whitney(df, F.col("x"), F.col("f")).first()["u"] == pytest.approx(u)
    ks = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in range(12))
    assert T.two_sample_ks(df, F.col("x"), F.col("f")).first()["ks"] == pytest.approx(ks)


def test_event_log(spark):
    e = [("f", 1, "Born", '{"u":1,"p":1}'), ("f", 5, "Died", '{"u":1,"p":1}'), ("f", 2, "Born", '{"u":2}'), ("f", 3, "Died", '{"u":3}'), ("f", 9, "Died", None), ("g", 1, "Born", "{cut")]
    df = spark.createDataFrame(e, "filename string, loop bigint, evtTypeName string, event_data string")
    u = F.get_json_object("event_data", "$.u")
    states = {r["u"]: r["state"] for r in E.lifecycle(df.withColumn("u", u).where("u is not null"), ["u"], "loop", F.col("evtTypeName") == "Born", F.col("evtTypeName") == "Died").collect()}
    assert states == {"1": "dead", "2": "alive", "3": "unborn"}
    assert {r["evtTypeName"]: r["n_files"] for r in E.event_profile(df, "filename", "evtTypeName").collect()} == {"Born": 2, "Died": 1}
    players = spark.createDataFrame([("f", 1), ("f", None)], "filename string, playerID int")
    a = E.attribute_events(df, players, "filename", "evtTypeName", "event_data", {"Born": ["$.p"], "Died": ["$.p"]}, "playerID")
    assert a.where("is_known").count() == 2 and a.where("slot = 'none'").count() == 4
    m = E.field_monotonicity(df, ["filename"], "loop", "event_data", {"u": "$.u"}).first()
    assert (m["n"], m["n_down"], m["low"], m["high"]) == (4, 1, 1.0, 3.0)
    assert rows(E.tick_gaps(df, "filename", "loop")) == [(1, 2), (2, 1), (4, 1)]


def test_mixed_model_agrees_with_brute_force(spark):
    """Restricted likelihood of unequal groups, against a fine search over the ratio."""
    r = np.random.default_rng(4)
    sizes = r.integers(1, 9, 60)
    rows = [(int(g), float(3 + a + r.normal(0, 1.5))) for g, (n, a) in enumerate(zip(sizes, r.normal(0, 1, 60))) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = T.icc_mixed(T.group_sums(df, "g", F.col("x"))).first()
    pdf = df.toPandas()
    n, m = pdf.groupby("g").x.count().to_numpy(), pdf.groupby("g").x.mean().to_numpy()
    ss, total = float(((pdf.x - pdf.groupby("g").x.transform("mean")) ** 2).sum()), len(pdf)

    def deviance(ratio):
        w = n / (1 + n * ratio)
        mu = (w * m).sum() / w.sum()
        res = (ss + (w * (m - mu) ** 2).sum()) / (total - 1)
        return (total - 1) * np.log(res) + np.log1p(n * ratio).sum() + np.log(w.sum())

    best = min(np.linspace(0, 3, 30_001), key=deviance)
    assert abs(got["icc"] - best / (1 + best)) < 1e-3 and got["low"] < got["icc"] < got["high"]
    alike = spark.createDataFrame([(i % 5, float(i // 5)) for i in range(50)], "g int, x double")
    assert T.icc_mixed(T.group_sums(alike, "g", F.col("x"))).first()["icc"] == 0
    for few in (df.limit(0), df.limit(1), spark.createDataFrame([(1, 2.0), (2, 2.0), (2, 2.0)], "g int, x double")):
        assert T.icc_mixed(T.group_sums(few, "g", F.col("x"))).first()["icc"] is None


def test_exact_quantiles(spark):
    xs = [float(x) for x in np.random.default_rng(1).integers(0, 40, 500)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    assert np.allclose(T.exact_quantiles(df, F.col("x"), [0, 0.05, 0.33, 0.5, 0.999, 1]), np.quantile(xs, [0, 0.05, 0.33, 0.5, 0.999, 1]))
    assert T.exact_quantiles(df.limit(0), F.col("x"), [0.5]) == []
    assert T.iqr_outliers(df.limit(0), "x").first()["n"] == 0


def test_justifications_block_and_dictionary(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, 1)], "id int, s string, c int")
    ledger = A.missingness_ledger(df, "v", {"c": {"mechanism": "MCAR", "justification": "by design"}}, identity=["id"])
    assert len(ledger.columns) == 17 and ledger.where("mechanism_justification is null or recommendation_justification is null").count() == 0
    assert ledger.where("column_name = 'c'").first()["mechanism_justification"] == "by design"
    block = A.audit_block({"v": ledger})["views"]["v"]
    assert block["total_rows"] == 3 and block["columns_audited"] == 3 == len(block["ledger"])
    known = spark.createDataFrame([("a",), ("z",), (None,), ("a",)], "k string")
    assert tuple(A.dictionary_match(df, "s", known, "k").first()) == (3, 1, 1, 1, 1)
    assert tuple(A.dictionary_match(df.limit(0), "s", known, "k").first()) == (0, 0, 0, 0, 2)


def test_render_never_cuts(spark):
    df = spark.range(1500)
    assert len(json.loads(sinks.render(df, "json"))) == 1500
    with pytest.raises(ValueError):
        sinks.render(df, "json", most=1499)


def test_glicko2_published_example(spark):
    """The worked example of the method's paper, and a period without matches."""
    initial = spark.createDataFrame([("p", 1500.0, 200.0, 0.06), ("a", 1400.0, 30.0, 0.06), ("b", 1550.0, 100.0, 0.06), ("c", 1700.0, 300.0, 0.06)], "entity string, rating double, deviation double, volatility double")
    played = [("p", "a", 1), ("b", "p", 1), ("c", "p", 1), ("x", "y", 2), ("b", "a", 3), (None, "p", 1), ("p", "p", 1)]
    m = spark.createDataFrame(played, "w string, l string, period int")
    got = {(r["entity"], r["period"]): r for r in X.glicko2_ratings(m, "w", "l", "period", tau=0.5, initial=initial).collect()}
    r = got["p", 1]
    assert (r["rating"], r["deviation"]) == (pytest.approx(1464.06, abs=0.02), pytest.approx(151.52, abs=0.02)) and r["volatility"] == pytest.approx(0.05999, abs=1e-5) and r["n"] == 3
    assert set(got) == {("p", 1), ("a", 1), ("b", 1), ("c", 1), ("x", 2), ("y", 2), ("a", 3), ("b", 3)}
    assert got["x", 2]["rating"] - 1500 == pytest.approx(1500 - got["y", 2]["rating"]) and got["x", 2]["rating"] > 1600
    assert X.glicko2_ratings(m.limit(0), "w", "l", "period", tau=0.5).count() == 0


def test_leakage_checks(spark):
    roles = {"rating_pre": "pre_game", "new_rating": "post_game", "won": "target", "source": "control"}
    assert X.role_check(["rating_pre", "new_rating", "source", "odd"], roles, ["pre_game", "control"]) == [("new_rating", "post_game"), ("odd", "undeclared")]
    df = spark.createDataFrame([(i % 2, i % 4 < 2) for i in range(100)], "slot int, won boolean")
    assert not X.slot_check(df, "slot", "won").first()["leaks"] and X.slot_check(df.where("won or slot = 1"), "slot", "won").first()["leaks"]
    assert not X.slot_check(df.limit(0), "slot", "won").first()["leaks"]
    train = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "k string, y int")
    fitted = spark.createDataFrame([("a", 0.5), (None, 1.0), ("b", None), ("c", 0.3)], "k string, rate double")
    assert tuple(X.fitted_check(fitted, train, "k", "rate", F.col("y")).first()) == (4, 1)
