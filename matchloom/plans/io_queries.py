"""Queries of sources, sinks and streaming forms. What they write goes to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import relational as R
from matchloom.plans.define import Group, Tables
from matchloom.session import shared_dir
from matchloom.sources import readers, schemas, sinks
from matchloom.streaming import sessions as stream

query = Group()


def _place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("select n_nationkey, n_name, n_regionkey, 'nation.parquet' as filename from nation")
def io_parquet_with_filename(t: Tables):
    return readers.read_parquet(t.spark, t.dir, "nation.parquet")


@query("select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice, o_orderpriority from orders")
def io_csv_typed(t: Tables):
    path = _place(t, "csv")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    t.orders.select(*cols).write.option("header", True).csv(path)
    schema = T.StructType([t.orders.schema[c] for c in cols])
    return readers.read_csv(t.spark, path, schema).drop("filename").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("select s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) as s_acctbal from supplier")
def io_csv_inferred(t: Tables):
    path = _place(t, "csv")
    t.supplier.write.option("header", True).csv(path)
    d = readers.read_csv(t.spark, path).drop("filename")
    return d.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def io_json_files(t: Tables):
    """Whole-file objects: an array of records per file, exploded."""
    path = _place(t, "json")
    rows = t.nation.coalesce(1).agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("rows"))).alias("value"))
    rows.write.text(path)
    j = readers.read_json_files(t.spark, path, "rows array<struct<n_nationkey:int,n_name:string,n_regionkey:int>>")
    return j.select(F.inline("rows"))


@query("""select filename, e.key as toon_id, e.value ->> '$.race' as race, try_cast(e.value ->> '$.APM' as int) as apm from (select * from replays_meta_raw where json_valid(ToonPlayerDescMap) and json_type(ToonPlayerDescMap) = 'OBJECT' and json_extract(ToonPlayerDescMap, '$.players') is null), lateral (select * from json_each(ToonPlayerDescMap)) as e""")
def io_map_entries(t: Tables):
    m = t.replays_meta_raw.where(F.schema_of_variant(F.try_parse_json("ToonPlayerDescMap")).startswith("OBJECT") & F.get_json_object("ToonPlayerDescMap", "$.players").isNull())
    e = readers.explode_map(m, "ToonPlayerDescMap", "toon_id", {"race": "race", "apm": "APM"})
    return e.withColumn("apm", F.col("apm").try_cast("int"))


@query("select event_id, user_id, 'k' as key, json_extract_string(props, '$.k') as value from events")
def io_flat_entries(t: Tables):
    e = t.events.withColumn("filename", F.struct("event_id", "user_id"))
    return readers.explode_map(e, "props", "key").select("filename.event_id", "filename.user_id", "key", "value")


@query("""select cast(user_id as varchar) as filename, case when event_type = 'error' then 'errors' else 'clicks' end as target, count(*) as n from events where event_type in ('error', 'click') group by 1, 2""")
def io_route_events(t: Tables):
    """Arrays of one object routed to several outputs in one scan."""
    event = F.struct(F.col("event_id").alias("loop"), F.col("event_type").alias("evtTypeName"), "value")
    of = lambda k: F.collect_list(F.when(F.col("event_type") == k, event))
    files = t.events.groupBy(F.col("user_id").cast("string").alias("filename")).agg(of("error").alias("e"), of("click").alias("c"))
    routed = readers.route_events(files, {"errors": "e", "clicks": "c"})
    parts = [df.groupBy("filename").agg(F.count("*").alias("n")).withColumn("target", F.lit(k)) for k, df in routed.items()]
    return parts[0].unionByName(parts[1])


@query()
def io_inventory(t: Tables):
    return readers.inventory(t.spark, t.dir, "*.parquet")


@query()
def io_parquet_footers(t: Tables):
    return schemas.parquet_footers(t.spark, t.dir).groupBy("column_name", "type").agg(F.count("*").alias("n_files"))


def _drifting_files(t: Tables) -> str:
    """The orders as three files: whole, one column retyped, one column missing."""
    path = _place(t, "drifting")
    o = t.orders.coalesce(1)
    o.write.parquet(f"{path}/a")
    o.withColumn("o_custkey", F.col("o_custkey").cast("string")).write.parquet(f"{path}/b")
    o.drop("o_orderpriority").write.parquet(f"{path}/c")
    return path


@query("""select * from (values ('o_orderkey', 'int64', 3, false), ('o_custkey', 'int64', 2, true), ('o_custkey', 'string', 1, true), ('o_orderstatus', 'string', 3, false), ('o_totalprice', 'double', 3, false), ('o_orderdate', (select any_value(case when typeof(o_orderdate) like 'TIMESTAMP%' then 'timestamp' end) from orders), 3, false), ('o_orderpriority', 'string', 2, true)) as v(column_name, type, n_files, is_variant)""")
def io_type_census(t: Tables):
    """Of three files only the retyped column and the missing one are variants."""
    c = schemas.type_census(schemas.parquet_footers(t.spark, _drifting_files(t)))
    return c.withColumn("type", F.regexp_replace("type", r"^timestamp.*", "timestamp"))


@query()
def io_compare_schemas(t: Tables):
    c = schemas.compare_schemas(schemas.parquet_footers(t.spark, _drifting_files(t)))
    return c.agg(F.count("*").alias("n_schemas"), F.sum("n_files").alias("n_files"))


@query("""with e as (select key, json_extract(record, '$."' || key || '"') as v from (select record, unnest(json_keys(record)) as key from raw_records where json_valid(record) and json_type(record) = 'OBJECT')),
k as (select key, case json_type(v) when 'NULL' then 'null' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'object' end as t from e),
g as (select key, count(*) as n, string_agg(distinct t, ',' order by t) as types, count(distinct t) filter (where t <> 'null') as d, count(*) filter (where t = 'integer') as i, count(*) filter (where t = 'decimal') as f, count(*) filter (where t = 'boolean') as b, count(*) filter (where t <> 'null') as m from k group by 1)
select key, n, types, case when d = 0 then 'string' when i = m then 'bigint' when i + f = m then 'double' when b = m then 'boolean' else 'string' end as proposed from g""")
def io_json_root_keys(t: Tables):
    return schemas.json_root_keys(t.raw_records, "record").withColumn("types", F.array_join("types", ","))


@query("""select s_suppkey, s_name, s_nationkey from supplier union all select c_custkey, null, c_nationkey from customer""")
def io_table_append(t: Tables):
    """A table created anew, and appended to by name; columns that are missing are null."""
    name = f"loom_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"create database {name} location '{_place(t, 'database')}'")
    sinks.create_table(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), f"{name}.people")
    sinks.append_by_name(t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey")), f"{name}.people")
    return t.spark.table(f"{name}.people")


@query("select 'loom_supplier' as table_name, count(*) as n_rows from supplier union all select 'loom_customer', count(*) from customer")
def io_row_counts(t: Tables):
    t.supplier.createOrReplaceTempView("loom_supplier")
    t.customer.createOrReplaceTempView("loom_customer")
    return sinks.row_counts(t.spark, ["loom_supplier", "loom_customer"])


@query("""select cast(json_extract_string(j, '$.n_nationkey') as bigint) as n_nationkey, json_extract_string(j, '$.n_name') as n_name from (select to_json(n) as j from nation n)""")
def io_render_json(t: Tables):
    """A whole result as a JSON document, read again."""
    text = sinks.render(t.nation.select("n_nationkey", "n_name"), "json")
    df = t.spark.createDataFrame([(text,)], "j string")
    return df.select(F.inline(F.from_json("j", "array<struct<n_nationkey:bigint,n_name:string>>")))


@query()
def io_key_paths(t: Tables):
    paths = schemas.key_paths(t.replays_meta_raw.select("details", "header").schema)
    return t.spark.createDataFrame([(p,) for p in paths], "path string")


@query("""select n_regionkey, count(*) as n, sum(n_nationkey) as keys from nation group by 1""")
def io_scan_many_json_files(t: Tables):
    """One scan over as many files of whole JSON objects as there are regions."""
    path = _place(t, "json-files")
    n = t.nation.groupBy("n_regionkey").agg(F.to_json(F.struct(F.first("n_regionkey").alias("region"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))).alias("value"))
    n.repartition("n_regionkey").select("value").write.option("maxRecordsPerFile", 1).text(path)
    j = readers.read_json_files(t.spark, path, "region int, rows array<struct<n_nationkey:int,n_name:string>>")
    return j.select(F.col("region").alias("n_regionkey"), F.inline("rows")).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("""with a as (select distinct regexp_extract(filename, '(\\d{4}-\\d{2}-\\d{2})_', 1) as key from matches_raw), b as (select distinct regexp_extract(filename, '(\\d{4}-\\d{2}-\\d{2})\\.csv', 1) as key from ratings_raw)
select key, 'a' as side from a where key not in (select key from b) union all select key, 'b' from b where key not in (select key from a)""")
def io_file_gaps(t: Tables):
    a = t.matches_raw.select(F.regexp_extract("filename", r"(\d{4}-\d{2}-\d{2})_", 1).alias("d")).distinct()
    b = t.ratings_raw.select(F.regexp_extract("filename", r"(\d{4}-\d{2}-\d{2})\.csv", 1).alias("d")).distinct()
    return readers.file_gaps(a, b, F.col("d"))


@query("select c_custkey, c_nationkey, null::varchar as s_name, c_acctbal as balance from customer union all select s_suppkey, s_nationkey, s_name, s_acctbal from supplier")
def io_unite_by_name(t: Tables):
    """Files whose columns and types differ, as one table."""
    a = t.customer.select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_nationkey", F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), "s_name", F.col("s_acctbal").alias("balance"))
    return readers.unite_by_name([a, b])


@query("select l_orderkey, l_linenumber, l_shipmode from (select l_orderkey, l_linenumber, l_returnflag as l_shipmode from lineitem where l_returnflag = 'R')")
def io_parquet_sink(t: Tables):
    """A partitioned Parquet sink read back with one partition only."""
    path = _place(t, "sink")
    sinks.write_parquet(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("l_shipmode")), path, ["l_shipmode"])
    return t.spark.read.parquet(path).where("l_shipmode = 'R'").select("l_orderkey", "l_linenumber", "l_shipmode")


@query()
def io_engine_info(t: Tables):
    return sinks.engine_info(t.spark)


@query()
def io_byte_columns(t: Tables):
    return schemas.byte_columns(schemas.parquet_footers(t.spark, t.dir))


@query()
def io_describe(t: Tables):
    return sinks.describe(t.replays_meta_raw)


@query("""select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def stream_windowed_counts(t: Tables):
    w = stream.windowed_counts(t.events, "ts", ["event_type"], F.col("value"), "6 hours")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as session_end, count(*) as n from s group by user_id, i""")
def stream_sessions(t: Tables):
    s = stream.sessions(t.events, "ts", "user_id")
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", f("session_start"), f("session_end"), "n")


@query("""select 'matches_history' as part, count(*) as n from (select match_id, player_id from matches_long_raw where leaderboard_raw = 3 union all select match_id, player_id from matches_long_raw where leaderboard_raw = 4)""")
def io_union_shared_columns(t: Tables):
    part = lambda n: t.matches_long_raw.where(f"leaderboard_raw = {n}").select("match_id", "player_id")
    return part(3).unionByName(part(4)).agg(F.count("*").alias("n")).select(F.lit("matches_history").alias("part"), "n")


@query()
def io_sample_fingerprint(t: Tables):
    """A reproducible sample's fingerprint."""
    return R.table_fingerprint(R.entity_sample(t.matches_long_raw, "player_id", 0.1))
