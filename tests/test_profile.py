import re

from pyspark.sql import functions as F

from matchloom.operators.profile import column_profile, coverage_drift, expression_coverage, induce_expressions, ledger_errors, value_counts


def table(spark, n=60):
    rows = [(f"m/a/2024-0{1 + i % 2}-03", f"20{i % 25:02d}-{1 + i % 12:02d}-17", "fast" if i % 3 else None, float(-1 if i % 10 == 0 else i)) for i in range(n)]
    rows += [("m/a/2024-02-05", "??", "slow", None)]
    return spark.createDataFrame(rows, "filename string, day string, n string, value double")


LOAD_LENGTH = 11


def test_profile_and_ledger(spark):
    df = table(spark)
    counts = value_counts(df, "v", F.substring("filename", 1, LOAD_LENGTH), ["filename"])
    marks = spark.createDataFrame([("v", "m/a/2024-01", "value", "-1.0"), ("v", "m/a/2024-01", "n", None)], "view_name string, load_prefix string, column_name string, sentinel_value string")
    p = {(r["load_prefix"], r["column_name"]): r for r in column_profile(counts, marks).collect()}
    pdf = df.toPandas()
    for load, part in pdf.groupby(pdf.filename.str[:11]):
        for c in ("day", "n", "value"):
            r = p[load, c]
            assert (r["n_total"], r["n_null"], r["n_distinct"]) == (len(part), part[c].isna().sum(), part[c].nunique())
    one = pdf[pdf.filename.str[:11] == "m/a/2024-01"]
    assert p["m/a/2024-01", "value"]["n_sentinel"] == (one.value == -1).sum() > 0
    assert p["m/a/2024-02", "value"]["n_sentinel"] == 0
    assert p["m/a/2024-01", "value"]["min_number"] == -1
    good = [("v", k[0], k[1], r["pct_null"], r["n_distinct"], r["n_sentinel"]) for k, r in p.items()]
    bad = [("v", "m/a/2024-01", "n", good[0][3] + 90, 1, 0), ("v", "gone", "n", 0.0, 1, 0), ("v", "m/a/2024-01", "day", None, None, None)]
    ddl = "view_name string, load_prefix string, column_name string, pct_null double, n_distinct bigint, n_sentinel bigint"
    assert ledger_errors(column_profile(counts, marks), spark.createDataFrame(good, ddl)).count() == 0
    assert ledger_errors(column_profile(counts, marks), spark.createDataFrame(bad, ddl)).count() == 3


def test_expressions_describe_values(spark):
    counts = value_counts(table(spark, 600), "v", F.substring("filename", 1, LOAD_LENGTH), ["filename"])
    expressions, assignment = induce_expressions(counts)
    by = {}
    for r in expressions.where("column_name = 'day'").collect():
        by[r["shape"]] = r["expression"]
    assert "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]" in by.values()
    for r in assignment.where("column_name = 'day'").collect():
        if r["shape"] is None:
            assert r["value"] == "??"
        else:
            assert re.fullmatch(by[r["shape"]], r["value"])
    assert assignment.where("column_name = 'day' and shape is null").count() == 1
    d = coverage_drift(expression_coverage(counts, assignment), F.lit("a")).collect()
    r = next(x for x in d if x["column_name"] == "day")
    assert r["n_nonconforming"] == 1 and 0 < r["distance"] < 0.1


def test_special_characters_and_empty(spark):
    odd = spark.createDataFrame([("a+b.c(1)[2]",), ("é ü",), ("",), (None,), ("x" * 50_000,), ("$^",)], "s string")
    counts = value_counts(odd, "v", F.lit("l"))
    e, a = induce_expressions(counts)
    texts = {r["shape"]: r["expression"] for r in e.collect()}
    assert a.count() == 5
    for r in a.collect():
        if r["shape"] is not None:
            assert re.fullmatch(texts[r["shape"]], r["value"].replace("é", "e").replace("ü", "u"))
    assert column_profile(value_counts(odd.limit(0), "v", F.lit("l"))).count() == 0


def test_drift_of_columns_that_become_null(spark):
    loads = {"m/a/1": ["12", "34"], "m/a/2": [None, None], "m/a/3": ["56", None], "m/b/1": [None, None], "m/b/2": [None, None]}
    df = spark.createDataFrame([(k, v, "x") for k, vs in loads.items() for v in vs], "load string, c string, k string")
    counts = value_counts(df, "v", F.col("load"), ["load"])
    d = coverage_drift(expression_coverage(counts, induce_expressions(counts)[1]), F.substring("load_prefix", 1, 3))
    got = {(r["load_prefix"], r["column_name"]): (r["distance"], r["n_new_expressions"], r["null_share"], r["null_change"]) for r in d.collect()}
    same = (0.0, 0, 0.0, 0.0)
    assert got == {
        ("m/a/2", "c"): (1.0, 0, 1.0, 1.0), ("m/a/3", "c"): (0.5, 1, 0.5, -0.5), ("m/b/2", "c"): (0.0, 0, 1.0, 0.0),
        ("m/a/2", "k"): same, ("m/a/3", "k"): same, ("m/b/2", "k"): same,
    }
