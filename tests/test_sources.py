import json
import os

import pytest
from pyspark.sql import functions as F

from matchloom.sources import readers, schemas, sinks
from matchloom.streaming import sessions as stream
from tests.conftest import rows


def test_parquet_tree_with_provenance(spark, tmp_path):
    root = str(tmp_path / "raw")
    spark.createDataFrame([(1, "a")], "id int, name string").coalesce(1).write.parquet(f"{root}/w1")
    spark.createDataFrame([(2, b"b", 5)], "id int, blob binary, filename int").coalesce(1).write.parquet(f"{root}/w2")
    df = readers.read_parquet(spark, root, binary_as_string=True)
    assert set(df.columns) == {"id", "name", "blob", "filename"}
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["blob"] is None and got[2]["blob"] == "b"
    assert got[1]["filename"].startswith("w1/part-") and not got[2]["filename"].startswith("/")
    feet = schemas.parquet_footers(spark, root)
    assert feet.where("n_rows = 1").count() == 5
    census = {r["column_name"]: r["is_variant"] for r in schemas.type_census(feet).collect()}
    assert census == {"id": False, "name": True, "blob": True, "filename": True}
    assert schemas.compare_schemas(feet).count() == 2
    assert {r["directory"]: r["n_files"] for r in readers.inventory(spark, root, "*.parquet").collect()} == {"w1": 1, "w2": 1}
    assert readers.view_over_parquet(spark, "nothing_here", f"{root}/absent") == 0
    assert readers.view_over_parquet(spark, "w1", f"{root}/w1") == 1 and spark.table("w1").count() == 1


def test_csv(spark, tmp_path):
    root = tmp_path / "csv"
    root.mkdir()
    (root / "rating-2024-01-01.csv").write_text("profile_id,rating,date\n1,1000,2024-01-01 10:00:00\n2,,\n")
    (root / "rating-2024-01-02.csv").write_text("profile_id,rating,date\n")
    typed = readers.read_csv(spark, str(root), "profile_id bigint, rating int, date timestamp")
    assert rows(typed.select("profile_id", "rating", "filename")) == [(1, 1000, "rating-2024-01-01.csv"), (2, None, "rating-2024-01-01.csv")]
    assert readers.read_csv(spark, str(root)).schema["rating"].dataType.simpleString() == "int"
    assert readers.csv_schema(spark, str(root / "rating-2024-01-01.csv"), 1)["profile_id"].dataType.simpleString() == "int"
    gaps = readers.file_gaps(typed, spark.createDataFrame([("rating-2024-01-05.csv",)], "filename string"), F.regexp_extract("filename", r"(\d{4}-\d{2}-\d{2})", 1))
    assert rows(gaps) == [("2024-01-01", "a"), ("2024-01-05", "b")]


def test_json_objects_maps_and_events(spark, tmp_path):
    root = tmp_path / "json"
    (root / "t1" / "t1_data").mkdir(parents=True)
    game = {"map": {"1-S2-1-5": {"nickname": "x", "color": {"a": 1}}, "2-S2-1-6": {"nickname": None}}, "events": [{"loop": 3, "evtTypeName": "A", "v": 1}, {"loop": 4, "evtTypeName": "B"}], "other": []}
    (root / "t1" / "t1_data" / "one.json").write_text(json.dumps(game, indent=1))
    (root / "t1" / "t1_data" / "bad.json").write_text('{"map": {')
    ddl = "map map<string, struct<nickname:string, color:struct<a:int>>>, events array<struct<loop:bigint, evtTypeName:string, v:int>>, other array<struct<loop:bigint, evtTypeName:string, v:int>>"
    df = readers.read_json_files(spark, str(root), ddl)
    assert df.count() == 1
    assert rows(readers.broken_json_files(spark, str(root))) == [("t1/t1_data/bad.json",)]
    e = readers.explode_map(df, "map", "toon", {"nick": "nickname", "a": "color.a"})
    assert rows(e) == [("t1/t1_data/one.json", "1-S2-1-5", "x", 1), ("t1/t1_data/one.json", "2-S2-1-6", None, None)]
    routed = readers.route_events(df, {"events": "events", "other": "other"})
    assert routed["other"].count() == 0
    assert rows(routed["events"].select("loop", "evtTypeName", "event_data")) == [(3, "A", '{"loop":3,"evtTypeName":"A","v":1}'), (4, "B", '{"loop":4,"evtTypeName":"B"}')]
    text = spark.createDataFrame([("f", '{"k1":"v1","k2":"v2"}'), ("g", "{cut"), ("h", None)], "filename string, t string")
    assert rows(readers.explode_map(text, "t", "key")) == [("f", "k1", "v1"), ("f", "k2", "v2")]
    keys = {r["key"]: (r["types"], r["proposed"]) for r in schemas.json_root_keys(spark.createDataFrame([('{"a":1,"b":null,"c":"x"}',), ('{"a":1.5,"c":2}',), ("[1]",), (None,)], "t string"), "t").collect()}
    assert keys == {"a": (["decimal", "integer"], "double"), "b": (["null"], "string"), "c": (["integer", "string"], "string")}
    assert "map" not in schemas.key_paths(df.schema["events"].dataType) and "[].loop" in schemas.key_paths(df.schema["events"].dataType)


def test_unite_and_load(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(2.5, 7)], "id double, v int")
    u = readers.unite_by_name([a, b])
    assert u.schema.simpleString() == "struct<id:double,v:string>" and u.count() == 2
    n = readers.load_all({"a": lambda: a, "b": lambda: b.limit(0)}, lambda name, df: df.write.parquet(f"{tmp_path}/{name}"))
    assert rows(n) == [("a", 1), ("b", 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    sinks.create_table(df, "sink_t")
    sinks.append_by_name(spark.createDataFrame([(3,)], "id int"), "sink_t")
    assert rows(spark.table("sink_t")) == [(1, "x"), (2, None), (3, None)]
    assert rows(sinks.row_counts(spark, ["sink_t"])) == [("sink_t", 3)]
    assert sinks.list_tables(spark).where("name = 'sink_t'").count() == 1
    assert json.loads(sinks.render(df, "json")) == [{"id": 1, "name": "x"}, {"id": 2, "name": None}]
    assert sinks.render(df, "csv").splitlines()[0] == "id,name" and "name" in sinks.render(df)
    with pytest.raises(ValueError):
        sinks.render(df, "xml")
    folder = str(tmp_path / "schemas")
    path = sinks.export_schemas(spark, ["sink_t"], folder)[0]
    text = open(path).read().replace("  - name: name\n    type: string\n    nullable: true\n", "  - name: name\n    type: string\n    nullable: true\n    description: what people call it\n")
    with open(path, "w") as f:
        f.write(text)
    sinks.export_schemas(spark, ["sink_t"], folder)
    assert "description: what people call it" in open(path).read() and os.path.exists(f"{folder}/_index.yaml")
    sinks.write_artifact(df, f"{tmp_path}/a.json", "select 1")
    assert json.load(open(f"{tmp_path}/a.json"))["query"] == "select 1"
    sinks.write_bucketed(df, "bucketed_t", ["id"], 2)
    plan = spark.table("bucketed_t").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for t in ("sink_t", "bucketed_t"):
        spark.sql(f"drop table {t}")


def test_streams_agree_with_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    data = [(i % 3, datetime(2024, 1, 1) + timedelta(minutes=25 * i + 200 * (i // 7)), float(i)) for i in range(40)]
    df = spark.createDataFrame(data, "u int, ts timestamp, v double")
    df.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, op in (("w", lambda d: stream.windowed_counts(d, "ts", ["u"], F.col("v"))), ("s", lambda d: stream.sessions(d, "ts", "u"))):
        q = op(live).writeStream.format("memory").queryName(f"live_{name}").outputMode("complete" if name == "w" else "append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got, want = rows(spark.table(f"live_{name}")), rows(op(df))
        assert got == want if name == "w" else set(got) <= set(want)
