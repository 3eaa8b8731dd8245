import json

from pyspark.sql import types as T

from matchloom.plans.data_problems import p4_matches, p4_players
from matchloom.sources.drift import file_fields, kept_files, registry, schema_changes, schema_fields, unify

FILES = [
    ("d/x/1", [{"id": 1, "pop": 5, "m": True}, {"id": 2, "pop": 6, "m": None}, {"id": 3, "pop": 7, "m": False}]),
    ("d/x/2", [{"id": 2, "popCap": 6, "m": None}, {"id": 3, "popCap": 7, "m": 0}, {"id": 4, "popCap": 9, "m": 1}]),
    ("d/x/3", [{"id": 3, "max": 7.0, "m": 0}, {"id": 4, "max": 9.0, "m": 1}, {"id": 5, "max": 1.5, "m": 1, "tags": ["a"]}]),
    ("d/y/1", [{"id": 1, "a": "1"}, {"id": 2, "a": "x"}]),
    ("d/y/2", [{"id": "1", "b": "x"}, {"id": "2", "b": "y"}]),
]


def records(spark):
    rows = [(f, i + 1, json.dumps(r)) for f, rs in FILES for i, r in enumerate(rs)]
    rows += rows[:2] + [("d/x/1", 9, "{broken"), ("d/x/1", 8, "[1]"), ("d/x/2", 7, None), (None, 1, "{}")]
    return spark.createDataFrame(rows, "filename string, line_no int, record string")


def test_changes(spark):
    r = records(spark)
    files = kept_files(r)
    got = {tuple(r) for r in schema_changes(r, files, 2).select("filename", "change", "field", "new_field").collect()}
    assert got == {
        ("d/x/2", "renamed", "pop", "popCap"), ("d/x/2", "retyped", "m", ""),
        ("d/x/3", "renamed", "popCap", "max"), ("d/x/3", "added", "tags", ""),
        ("d/y/2", "retyped", "id", ""), ("d/y/2", "removed", "a", ""), ("d/y/2", "added", "b", ""),
    }
    assert files.select("version").distinct().count() == 5
    assert [tuple(x) for x in registry(files).select("dir", "version_no", "n_files", "first_file").orderBy("first_file").collect()] == [("d/x", 1, 1, "d/x/1"), ("d/x", 2, 1, "d/x/2"), ("d/x", 3, 1, "d/x/3"), ("d/y", 1, 1, "d/y/1"), ("d/y", 2, 1, "d/y/2")]


def test_unify(spark):
    r = records(spark)
    files = kept_files(r)
    target = T.StructType.fromDDL("id int, pop int, m boolean, extra_col string")
    out = {(r["filename"], r["line_no"]): r for r in unify(r, files, schema_changes(r, files, 2), target, {"extra_col": "none"}).collect()}
    assert len(out) == sum(len(r) for _, r in FILES)
    assert [out["d/x/3", i]["pop"] for i in (1, 2, 3)] == [7, 9, 1]
    assert out["d/x/2", 3]["m"] is True and out["d/x/2", 1]["m"] is None and out["d/y/2", 1]["id"] == 1
    assert out["d/x/3", 3]["extra"] == {"tags": '["a"]'} and out["d/x/1", 1]["extra_col"] == "none"


def test_ties_and_empty(spark):
    rows = [("q/1", 1, '{"a":1,"b":1}'), ("q/1", 2, '{"a":1,"b":1}'), ("q/2", 1, '{"c":1,"d":1}'), ("q/2", 2, '{"c":1,"d":1}')]
    r = spark.createDataFrame(rows, "filename string, line_no int, record string")
    got = {tuple(x)[1:] for x in schema_changes(r, kept_files(r), 2).select("filename", "change", "field", "new_field").collect()}
    assert got == {("renamed", "a", "c"), ("renamed", "b", "d")}
    assert schema_changes(r.limit(0), kept_files(r.limit(0)), 2).count() == 0


def test_schema_text():
    text = "OBJECT<a: BIGINT, `b: c``, d`: ARRAY<OBJECT<x: STRING, y: VOID>>, e: OBJECT<>, f: DECIMAL(3,1), g: DECIMAL(20,0), h: VOID, `: `: BOOLEAN>"
    assert schema_fields(text) == [("a", "integer"), ("b: c`, d", "array"), ("e", "object"), ("f", "decimal"), ("g", "integer"), ("h", None), (": ", "boolean")]


def test_kept_registry_is_extended(spark, tmp_path):
    r, store = records(spark), str(tmp_path / "files")
    first = r.where("filename < 'd/x/3' or filename > 'd/y/1'")
    assert kept_files(first, store).count() == 3
    got = {(x["filename"], x["version_no"]) for x in kept_files(r, store).collect()}
    assert got == {(x["filename"], x["version_no"]) for x in kept_files(r).collect()} and len(got) == 5
    assert kept_files(r, store).count() == 5


def test_one_shared_line_and_odd_names(spark):
    rows = [("q/1", 1, '{"a b":1, "x.y":[{"p, q":null}]}'), ("q/2", 1, '{"a: b":1, "x.y":null}'), ("q/2", 2, "{}")]
    r = spark.createDataFrame(rows, "filename string, line_no int, record string")
    files = kept_files(r)
    assert [(x["lo"], x["hi"], [tuple(y) for y in x["fields"]]) for x in file_fields(r).orderBy("filename").collect()] == [(1, 1, [("a b", "integer"), ("x.y", "array")]), (1, 1, [("a: b", "integer"), ("x.y", "")])]
    assert [tuple(x) for x in schema_changes(r, files, 1).select("filename", "change", "field", "new_field").collect()] == [("q/2", "renamed", "a b", "a: b")]


def test_names_that_change_places(spark):
    rows = [("q/1", 1, '{"a":1,"b":2}'), ("q/2", 1, '{"c":1,"b":2}'), ("q/2", 2, '{"c":3,"b":4}'), ("q/3", 1, '{"c":3,"a":4}'), ("q/3", 2, '{"c":5,"a":6}')]
    r = spark.createDataFrame(rows, "filename string, line_no int, record string")
    files = kept_files(r)
    out = unify(r, files, schema_changes(r, files, 1), T.StructType.fromDDL("a int, b int"))
    assert sorted((x["filename"], x["line_no"], x["a"], x["b"]) for x in out.collect()) == [("q/1", 1, 1, 2), ("q/2", 1, 1, 2), ("q/2", 2, 3, 4), ("q/3", 1, 3, 4), ("q/3", 2, 5, 6)]


def test_added_fields_stay(spark, tmp_path):
    """Fields beyond the loaded tables' keep their values, through a renaming too."""
    files = [
        ("1", [{"matchId": 1, "profile_id": 1}, {"matchId": 2, "profile_id": 2}]),
        ("2", [{"matchId": 1, "profile_id": 1, "seen": 3}, {"matchId": 2, "profile_id": 2, "seen": None}, {"matchId": 3, "profile_id": 3, "seen": 4}]),
        ("3", [{"matchId": 2, "profile_id": 2, "watched": None}, {"matchId": 3, "profile_id": 3, "watched": 4}, {"matchId": 4, "profile_id": 4, "watched": 5}]),
    ]
    rows = [(f"{s}/f/{n}", i + 1, json.dumps(r)) for s in ("matches", "players") for n, rs in files for i, r in enumerate(rs)]
    rows.append(("matches/f/3", 3, json.dumps({"matchId": 4, "watched": 6})))
    spark.createDataFrame(rows, "filename string, line_no int, record string").write.parquet(f"{tmp_path}/raw_records.parquet")
    for name, ddl in (("matches_raw", "matchId int, filename string"), ("players_raw", "profile_id double, filename string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    for query, last, other in ((p4_matches, "6", "profile_id"), (p4_players, "5", "matchId")):
        got = {(r["filename"][-1], r["line_no"]): r["extra"] for r in query(spark, str(tmp_path)).collect()}
        assert [got[k].get("seen") for k in sorted(got)] == [None, None, "3", "null", "4", "null", "4", last]
        assert all(v[other] for v in got.values())
