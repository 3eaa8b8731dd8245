"""Schemas of files without reading their data: footers, censuses, JSON keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.scalar import relative_name


def files_below(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return f.select("path", "length")


def parquet_footers(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """filename, column_name, type, n_rows, problem of every file, from footers only, which
    are read on the executors. Paths may be of any file system that Arrow knows (local,
    HDFS, object stores); unreadable files have one row with type 'unreadable' and what is
    wrong with them as `problem`."""
    files = files_below(spark, root, glob).select("path", relative_name(F.col("path"), root).alias("filename"))

    def run(batches):
        import pandas as pd
        import pyarrow.fs as pf
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for path, name in zip(b["path"], b["filename"]):
                try:
                    system, place = pf.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    f = pq.ParquetFile(place, filesystem=system)
                    rows += [(name, c.name, str(c.type), f.metadata.num_rows, None) for c in f.schema_arrow]
                except (OSError, ValueError, KeyError, NotImplementedError) as e:
                    rows.append((name, None, "unreadable", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filename", "column_name", "type", "n_rows", "problem"])

    return files.mapInPandas(run, "filename string, column_name string, type string, n_rows bigint, problem string")


def type_census(footers: DataFrame) -> DataFrame:
    """column_name, type, n_files, is_variant: the types that a column has across files;
    is_variant if more than one, or if some file lacks it."""
    f = footers.where("column_name is not null")
    total = f.agg(F.countDistinct("filename").alias("files"))
    by = f.groupBy("column_name", "type").agg(F.countDistinct("filename").alias("n_files"))
    return by.crossJoin(F.broadcast(total)).withColumn("is_variant", F.col("n_files") < F.col("files")).drop("files")


def json_root_keys(texts: DataFrame, column: str) -> DataFrame:
    """key, n, types, proposed: root keys of JSON texts, how many records have them, the
    JSON types of their values, and a column type that holds them all."""
    v = texts.select(F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    e = v.lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", F.schema_of_variant("value").alias("t"))
    kind = F.when(F.col("t") == "VOID", "null").when(F.col("t").startswith("OBJECT"), "object").when(F.col("t").startswith("ARRAY"), "array").when(F.col("t").startswith("DECIMAL") | F.col("t").isin("DOUBLE", "FLOAT"), "decimal").when(F.col("t") == "BIGINT", "integer").otherwise(F.lower("t"))
    by = e.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(kind)).alias("types"))
    t = F.array_remove("types", "null")
    only = lambda *ks: F.size(F.array_except(t, F.array(*[F.lit(k) for k in ks]))) == 0
    proposed = F.when(F.size(t) == 0, "string").when(only("integer"), "bigint").when(only("integer", "decimal"), "double").when(only("boolean"), "boolean").otherwise("string")
    return by.withColumn("proposed", proposed)


def key_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields of a nested type; [] marks a step into an array."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            p = f"{prefix}.{f.name}" if prefix else f.name
            out += [p, *key_paths(f.dataType, p)]
        return out
    return key_paths(schema.elementType, prefix + "[]") if isinstance(schema, T.ArrayType) else []


def compare_schemas(footers: DataFrame) -> DataFrame:
    """fingerprint, n_files, first_file: files with the same columns and types together."""
    by = footers.groupBy("filename").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "type")))), 256).alias("fingerprint"))
    return by.groupBy("fingerprint").agg(F.count("*").alias("n_files"), F.min("filename").alias("first_file"))


def byte_columns(footers: DataFrame) -> DataFrame:
    """column_name, n_files: columns stored as bytes without saying that they are text,
    which are to be read with binary_as_string."""
    return footers.where("type in ('binary', 'large_binary')").groupBy("column_name").agg(F.countDistinct("filename").alias("n_files"))
