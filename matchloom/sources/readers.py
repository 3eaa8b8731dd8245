"""Scans with provenance: Parquet, CSV and JSON trees, maps and event arrays.

Every scan is one lazy read of all files; batching by file or directory, which engines
without spilling need, isn't. The column `filename` is the path below the raw root and
comes from the file metadata, so it costs nothing to read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.scalar import relative_name
from matchloom.session import path_exists

FILE = "filename"


def with_filename(df: DataFrame, root: str) -> DataFrame:
    """df, just read from files, with `filename` relative to root; a column of this name
    in the files is replaced."""
    name = relative_name(F.col("_metadata.file_path"), root)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (FILE, "_metadata")], name.alias(FILE))


def read_parquet(spark: SparkSession, root: str, glob: str = "", binary_as_string: bool = False) -> DataFrame:
    """All Parquet files below root (or those that glob names), columns united by name;
    a column that a file lacks is null there. binary_as_string reads byte columns as
    text. Types that differ between files are an error here: see unite_by_name."""
    reader = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True)
    df = reader.parquet(f"{root.rstrip('/')}/{glob}" if glob else root)
    if binary_as_string:
        df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema.fields], "_metadata")
    return with_filename(df, root)


def unite_by_name(frames: list[DataFrame]) -> DataFrame:
    """Frames one below the other by column name. Missing columns are null; a column
    whose type differs has the widest number type if all are numbers, else text."""
    names: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            names.setdefault(f.name, []).append(f.dataType)

    def widest(types: list[T.DataType]) -> T.DataType:
        kinds = {t.simpleString(): t for t in types}
        if len(kinds) == 1:
            return types[0]
        if all(isinstance(t, T.IntegralType) for t in types):
            return T.LongType()
        return T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()

    target = {n: widest(ts) for n, ts in names.items()}
    out: DataFrame | None = None
    for df in frames:
        part = df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in target.items()])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no frames")
    return out


def read_csv(spark: SparkSession, root: str, schema: T.StructType | str | None = None, sample: float | None = None) -> DataFrame:
    """CSV files with a header. With a schema, as pipelines should: no extra pass. Without
    one types are inferred from all rows, or from a share of them."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
        if sample is not None:
            reader = reader.option("samplingRatio", sample)
    return with_filename(reader.csv(root), root)


def csv_schema(spark: SparkSession, path: str, rows: int = 50) -> T.StructType:
    """Column types of a CSV file judged by its first rows."""
    lines = [r["value"] for r in spark.read.text(path).limit(rows + 1).collect()]
    return spark.read.option("header", True).option("inferSchema", True).csv(spark.sparkContext.parallelize(lines, 1)).schema


def read_json_files(spark: SparkSession, root: str, schema: T.StructType | str | None = None, glob: str | None = None) -> DataFrame:
    """One row per file that is one JSON object. Files that aren't JSON are left out and
    counted by broken_json_files. A file is a task's unit and must fit into it."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema is None:
        inferred = reader.json(root)
        schema = T.StructType([f for f in inferred.schema.fields if f.name != "_corrupt_record"])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = with_filename(reader.schema(full).json(root), root)
    # Spark refuses plans that need the corrupt record only, such as a count: name another column, to no effect
    bad, other = F.col("_corrupt_record"), F.col(f"`{schema.fields[0].name}`")
    return df.where(bad.isNull() | ((bad == "\x00") & other.isNotNull())).drop("_corrupt_record")


def broken_json_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """filename of every file that isn't JSON, for a warning."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    f = reader.load(root).select("path", F.col("content").cast("string").alias("text"))
    return f.where(F.try_parse_json("text").isNull()).select(relative_name(F.col("path"), root).alias(FILE))


def explode_map(df: DataFrame, column: str, key: str, fields: dict[str, str] | None = None) -> DataFrame:
    """One row per entry of a map column, which may be JSON text of one object with free
    keys: filename, key, and the entry's fields, named as new name -> path within the
    entry, or its text as `value`. Broken texts and null maps give no rows."""
    c = F.col(column)
    entries = c if isinstance(df.schema[column].dataType, T.MapType) else F.from_json(c, "map<string,string>")
    e = df.select(FILE, F.explode(entries).alias(key, "__v"))
    if fields is None:
        return e.withColumnRenamed("__v", "value")
    if isinstance(e.schema["__v"].dataType, T.StructType):
        return e.select(FILE, key, *[F.col(f"__v.{p}").alias(n) for n, p in fields.items()])
    return e.select(FILE, key, *[F.get_json_object("__v", f"$.{p}").alias(n) for n, p in fields.items()])


def route_events(df: DataFrame, arrays: dict[str, str], loop: str = "loop", kind: str = "evtTypeName") -> dict[str, DataFrame]:
    """name -> (filename, loop, evtTypeName, event_data) for array columns of one scan:
    one row per element, its content as JSON text. Persist df if several are written."""
    out = {}
    for name, column in arrays.items():
        e = df.select(FILE, F.explode(F.col(column)).alias("e"))
        out[name] = e.select(FILE, F.col(f"e.{loop}").cast("bigint").alias("loop"), F.col(f"e.{kind}").alias("evtTypeName"), F.to_json("e").alias("event_data"))
    return out


def view_over_parquet(spark: SparkSession, name: str, path: str) -> int:
    """Register a view over a folder of Parquet files and return its rows; a missing
    folder gives 0 and no view. The files stay the only copy."""
    if not path_exists(spark, path):
        return 0
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df.count()


def load_all(sources: dict[str, Callable[[], DataFrame]], write: Callable[[str, DataFrame], None]) -> DataFrame:
    """Run named scans and write each; table_name, n_rows of what was written, counted on
    the way to the sink, without another pass."""
    from pyspark.sql import Observation

    rows, spark = [], None
    for name, scan in sources.items():
        df = scan()
        spark, seen = df.sparkSession, Observation(name)
        write(name, df.observe(seen, F.count(F.lit(1)).alias("n")))
        rows.append((name, seen.get["n"]))
    if spark is None:
        raise ValueError("no sources")
    return spark.createDataFrame(rows, "table_name string, n_rows bigint")


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """directory, n_files, n_bytes of the files below root; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    name = relative_name(F.col("path"), root)
    return f.groupBy(F.regexp_extract(name, "^(.*?)/?[^/]*$", 1).alias("directory")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def file_gaps(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """key, side: keys made of the file names (a week, a day) in only one of two sets."""
    x = a.select(key.alias("key")).where("key is not null and key <> ''").distinct()
    y = b.select(key.alias("key")).where("key is not null and key <> ''").distinct()
    return x.join(y, "key", "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, "key", "left_anti").withColumn("side", F.lit("b")))
