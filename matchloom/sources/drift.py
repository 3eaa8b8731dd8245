"""Files whose fields drift: a registry of schema versions, a log of every change, one
consistent table.

Each file of JSON lines has a schema fingerprint (its fields and their types). Files of a
directory, by name, that follow each other with the same fingerprint are one version; the
registry holds a directory's versions with their fields and files, and may be kept and
extended. Where one version follows another, the files on both sides are compared and
each difference is a migration step (renamed, retyped, added, removed). A version's route
is the chain of its directory's renamings up to it; a file's records are taken along the
route of its version back to the name that a field had first, get defaults, and are cast
to the target's types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from matchloom.session import materialise, path_exists

_DIR = r"^(.*?)/?[^/]*$"
#: A field of a variant's schema up to its type.
_FIELD = re.compile(r"(`(?:[^`]|``)*`|[^:`]*): ")
_BRACKET = re.compile(r"[<>]|`(?:[^`]|``)*`|, ")


def _type(sql: str) -> str | None:
    """The JSON type of a variant's SQL type; None for a JSON null."""
    name = re.match("[A-Z]+", sql).group()
    if name == "DECIMAL":  # beyond 64 bits without a point an integer; shorter ones were written with one
        return "integer" if re.fullmatch(r"DECIMAL\((19|[23]\d),0\)", sql) else "decimal"
    kinds = {"VOID": None, "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "DOUBLE": "decimal", "FLOAT": "decimal"}
    return kinds.get(name, "integer" if name in ("TINYINT", "SMALLINT", "INT", "BIGINT") else "object")


def schema_fields(schema: str) -> list[tuple[str, str | None]]:
    """(field, type) for each field of an object's schema, OBJECT<name: TYPE, ...>."""
    out, at, end = [], len("OBJECT<"), len(schema) - 1
    while at < end:
        m = _FIELD.match(schema, at)
        name = m.group(1)
        if name.startswith("`"):
            name = name[1:-1].replace("``", "`")
        depth, stop = 0, end
        for b in _BRACKET.finditer(schema, m.end(), end):
            if b.group() == "<":
                depth += 1
            elif b.group() == ">":
                depth -= 1
            elif b.group() == ", " and not depth:
                stop = b.start()
                break
        out.append((name, _type(schema[m.end() : stop])))
        at = stop + 2
    return out


def _explode_schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(f, *field, lo, hi) for f, s, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4))) for field in schema_fields(s)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["filename", "field", "type", "lo", "hi"])


def file_fields(records: DataFrame) -> DataFrame:
    """(dir, filename, lo, hi, fields): each file's first and last line, and its fields
    as a sorted array of (field, type); the types that a field has in one file are joined
    by '|', a field of nulls only has type ''.

    records: filename, line_no, record (one JSON object as text). One pass: a record is
    brought down to its schema, and a file's distinct schemas are what is shuffled. Null,
    broken and non-object records, and objects without fields, don't count."""
    schema = F.schema_of_variant(F.try_parse_json("record"))
    # numbers of other precision make no other schema
    schema = F.regexp_replace(F.regexp_replace(schema, r": DECIMAL\((?:19|[23]\d),0\)", ": BIGINT"), r": DECIMAL\(\d+,\d+\)", ": DECIMAL")
    r = records.where("filename is not null").select("filename", F.col("line_no").cast("bigint").alias("line_no"), schema.alias("schema")).where("schema like 'OBJECT<_%' and schema <> 'OBJECT<>'")
    r = r.groupBy("filename", "schema").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    f = r.mapInArrow(_explode_schemas, "filename string, field string, type string, lo bigint, hi bigint")
    f = f.groupBy("filename", "field").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    f = f.groupBy("filename").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("field", "type"))).alias("fields"))
    return f.select(F.regexp_extract("filename", _DIR, 1).alias("dir"), "filename", "lo", "hi", "fields")


def fingerprints(files: DataFrame) -> DataFrame:
    """files (as file_fields gives them) with version, the fingerprint: a hash of the
    sorted field:type list, and version_no: which of the directory's versions, by the
    names of its files, the file is of, from 1. A version that comes back later has its
    old fingerprint and a new number."""
    text = F.concat_ws(",", F.transform("fields", lambda x: F.concat_ws(":", x["field"], F.when(x["type"] == "", "?").otherwise(x["type"]))))
    f = files.withColumn("version", F.sha2(text, 256))
    order = Window.partitionBy("dir").orderBy("filename")
    f = f.withColumn("prev", F.lag(F.struct("filename", "version", "hi", "fields")).over(order))
    return f.withColumn("version_no", F.sum(F.when(F.col("prev.version") == F.col("version"), 0).otherwise(1)).over(order).cast("int"))


def registry(files: DataFrame) -> DataFrame:
    """(dir, version_no, version, n_fields, fields, n_files, first_file, last_file): the
    schema versions of each directory. files: as fingerprints gives them."""
    by = files.groupBy("dir", "version_no", "version").agg(F.first("fields").alias("fields"), F.count("*").alias("n_files"), F.min("filename").alias("first_file"), F.max("filename").alias("last_file"))
    return by.select("dir", "version_no", "version", F.size("fields").alias("n_fields"), "fields", "n_files", "first_file", "last_file")


def kept_files(records: DataFrame, store: str | None = None) -> DataFrame:
    """fingerprints of all files: those of `store`, a folder of Parquet, and those that
    records has beyond them, which are added to the store. A file in the store isn't read
    again, so that a new delivery costs only its own files. Files that are new but have
    names before those in the store take their place by name."""
    if store is None:
        return fingerprints(materialise(file_fields(records), "file-fields"))
    spark = records.sparkSession
    if path_exists(spark, store):
        have = spark.read.parquet(store).dropDuplicates(["filename"])
        new = file_fields(records.join(have.select("filename"), "filename", "left_anti"))
        new.write.mode("append").parquet(store)
    else:
        file_fields(records).write.parquet(store)
    return fingerprints(spark.read.parquet(store).dropDuplicates(["filename"]))


def _line_values(records: DataFrame, lines: DataFrame) -> DataFrame:
    """(filename, line_no, field, text) of the records on `lines` (filename, line_no),
    the text being the value's JSON. Of repeated lines the greatest text counts."""
    spark = records.sparkSession
    r = records.select("filename", F.col("line_no").cast("bigint").alias("line_no"), "record").join(lines, ["filename", "line_no"], "left_semi")
    r = r.select("filename", "line_no", F.try_parse_json("record").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    r = r.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return r.groupBy("filename", "line_no", F.col("key").alias("field")).agg(F.max(F.to_json("value")).alias("text"))


def schema_changes(records: DataFrame, files: DataFrame, shared: int) -> DataFrame:
    """(dir, filename, version_no, change, field, new_field): the differences of each
    file from the one before it, by name, in its directory. filename is the later file.

    files: the registry's files, as kept_files gives them; only where the version changes
    is there anything to compare. shared: lines that a file repeats from the end of the
    one before it. renamed: a key is gone, a new one is there, and both hold the same
    values in the shared lines (the earlier file's last, the later one's first; at least
    one has to hold the key). Should several fit, each key takes part in one renaming, in
    the order of names. removed, added: all other keys gone or new. retyped: same key,
    other type of its non-null values; a key with nulls only has no type. A field whose
    values in one file have several types has them all, joined by '|'. The first file of
    a directory gives no rows; repeated lines count once."""
    # read several times below: the records are gone through once for it
    turns = materialise(files.where("prev is not null and prev.version <> version"), "version-turns")
    side = lambda c, t, n: turns.select("dir", "filename", "version_no", F.inline(c)).withColumnRenamed("type", t).withColumn(n, F.lit(1))
    key = ["dir", "filename", "version_no"]
    both = side("prev.fields", "t0", "o").join(side("fields", "t1", "n"), [*key, "field"], "full")
    both = materialise(both, "field-changes")
    gone = both.where("n is null").select(*key, F.col("field").alias("old"))
    come = both.where("o is null").select(*key, F.col("field").alias("new"))
    # the shared lines of files where a key is gone and a new one there
    ask = turns.join(gone.select("filename").distinct(), "filename", "left_semi").join(come.select("filename").distinct(), "filename", "left_semi")
    steps = F.explode(F.sequence(F.lit(0), F.lit(shared - 1))).alias("i")
    before = ask.select(F.col("filename").alias("later"), F.col("prev.filename").alias("filename"), F.col("prev.hi").alias("at"), steps).select("later", "filename", (F.col("at") - (shared - 1) + F.col("i")).alias("line_no"), "i", F.lit(True).alias("earlier"))
    after = ask.select(F.col("filename").alias("later"), "filename", F.col("lo").alias("at"), steps).select("later", "filename", (F.col("at") + F.col("i")).alias("line_no"), "i", F.lit(False).alias("earlier"))
    lines = materialise(before.unionByName(after), "shared-lines")
    values = _line_values(records, lines.select("filename", "line_no").distinct()).join(lines, ["filename", "line_no"])
    values = values.groupBy(F.col("later").alias("filename"), "field", "earlier").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("v"))
    values = materialise(values, "shared-values")
    a = values.where("earlier").select("filename", F.col("field").alias("old"), "v")
    b = values.where("not earlier").select("filename", F.col("field").alias("new"), "v")
    fits = gone.join(a, ["filename", "old"]).join(come.join(b, ["filename", "new"]), [*key, "v"])
    rank = lambda c: F.dense_rank().over(Window.partitionBy("filename", "v").orderBy(c))
    renamed = fits.withColumn("i", rank("old")).withColumn("j", rank("new")).where("i = j").select(*key, F.lit("renamed").alias("change"), F.col("old").alias("field"), F.col("new").alias("new_field"))
    left = lambda df, name, by_: df.select(*key, F.col(name).alias("field")).join(renamed.select("filename", F.col(by_).alias("field")), ["filename", "field"], "left_anti")
    rest = lambda df, change: df.select(*key, F.lit(change).alias("change"), "field", F.lit("").alias("new_field"))
    retyped = both.where("o = 1 and n = 1 and t0 <> t1 and t0 <> '' and t1 <> ''")
    return renamed.unionByName(rest(left(gone, "old", "field"), "removed")).unionByName(rest(left(come, "new", "new_field"), "added")).unionByName(rest(retyped, "retyped"))


def version_routes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(dir, version_no, route): for each version, the fields that had another name at
    first, as a map from that first name to the version's. A directory's versions and
    renamings, not its files or records, are gone through in order."""
    steps = changes.where("change = 'renamed'").select("dir", "version_no", "field", "new_field")
    rows = files.select("dir", "version_no").distinct().join(steps, ["dir", "version_no"], "left")

    def route(pdf: pd.DataFrame) -> pd.DataFrame:
        names, out = {}, []
        for version, part in pdf.sort_values("version_no").groupby("version_no", sort=True):
            moved = {new: names.pop(old, old) for old, new in zip(part["field"], part["new_field"]) if isinstance(old, str)}
            names.update({k: v for k, v in moved.items() if k != v})
            out.append((pdf["dir"].iloc[0], version, {v: k for k, v in names.items()}))
        return pd.DataFrame(out, columns=["dir", "version_no", "route"])

    return rows.groupBy("dir").applyInPandas(route, "dir string, version_no int, route map<string,string>")


def unify(records: DataFrame, files: DataFrame, changes: DataFrame, target: T.StructType, default: dict[str, object] | None = None) -> DataFrame:
    """One row per line of a file with the columns of `target` (names as the first file of
    a chain has them), dir, filename, line_no and `extra` (a map of fields beyond the
    target, as JSON, under their first names).

    A value that can't be cast to the target's type is null; a field that a record lacks,
    or has as null, has its `default`, else null. Records under one line number are one; of
    several values of a field there the greatest text is taken. Lines without a number
    are rows of their own. The only shuffle of records is for that; each reads its values
    along the route of its file's version."""
    is_object = F.schema_of_variant(F.try_parse_json("record")).startswith("OBJECT<")
    r = records.where(F.col("filename").isNotNull() & is_object).select("filename", F.col("line_no").cast("bigint").alias("line_no"), "record")
    r = r.groupBy("filename", "line_no", F.when(F.col("line_no").isNull(), F.col("record")).alias("own")).agg(F.collect_set("record").alias("records"))
    text = lambda v: v.cast("string")
    either = lambda k, a, b: F.when(text(b).isNull() | (text(a) > text(b)), F.coalesce(a, b)).otherwise(b)
    ms = F.transform("records", lambda x: F.parse_json(x).cast("map<string,variant>"))
    by_file = files.select("dir", "filename", "version_no").join(version_routes(files, changes), ["dir", "version_no"], "left").select("dir", "filename", F.coalesce("route", F.expr("map()").cast("map<string,string>")).alias("__route"))
    r = r.join(by_file, "filename").withColumn("ms", ms)
    r = r.withColumn("__m", F.when(F.size("ms") == 1, F.col("ms")[0]).otherwise(F.aggregate(F.slice("ms", 2, F.size("ms")), F.col("ms")[0], lambda a, b: F.map_zip_with(a, b, either))))
    names = target.fieldNames()

    def now(c: Column) -> Column:
        """What a field's first name has become; null if another field has taken it."""
        return F.coalesce(F.col("__route")[c], F.when(~F.array_contains(F.map_values("__route"), c), c))

    def cast(field: T.StructField) -> Column:
        c = F.col("__m")[now(F.lit(field.name))].cast("string")
        if isinstance(field.dataType, T.IntegralType):
            v = F.coalesce(c.try_cast(field.dataType), c.try_cast("double").try_cast(field.dataType))
        elif isinstance(field.dataType, T.BooleanType):
            v = F.when(c.isin("1", "true", "True"), True).when(c.isin("0", "false", "False"), False)
        else:
            v = c.try_cast(field.dataType)
        d = (default or {}).get(field.name)
        return (v if d is None else F.coalesce(v, F.lit(d).cast(field.dataType))).alias(field.name)

    first = F.map_from_arrays(F.map_values("__route"), F.map_keys("__route"))
    r = r.withColumn("__first", first)
    origin = lambda k: F.coalesce(F.col("__first")[k], k)
    beyond = F.filter(F.map_keys("__m"), lambda k: ~origin(k).isin(names))
    extra = F.map_from_entries(F.transform(beyond, lambda k: F.struct(origin(k).alias("key"), F.to_json(F.col("__m")[k]).alias("value"))))
    return r.select("dir", "filename", "line_no", *[cast(x) for x in target.fields], extra.alias("extra"))
