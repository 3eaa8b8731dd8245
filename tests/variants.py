"""Copies of the test tables with what operators have to bear: no rows, rows of nulls,
repeated rows, further columns with names that operators use themselves."""

import glob
import os

from pyspark.sql import functions as F

from tests.sql_check import DATA

CLASHING = ["value", "entity", "row", "raw", "zone", "instant", "strip", "cell", "n", "doc", "word", "t", "size", "piece", "container", "account", "person", "node", "parent", "fields", "__k", "player", "strength", "i", "v", "load_prefix_", "w", "l"]


def build(spark, kind, folder):
    for p in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(p)
        if name.split(".")[0] in ("lineitem", "orders", "embeddings", "events"):
            continue
        df = spark.read.parquet(p)
        if kind == "empty":
            df = df.limit(0)
        elif kind == "nulls":
            df = df.unionByName(spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
        elif kind == "repeats":
            df = df.unionByName(df.limit(200))
        elif kind == "columns":
            have = {c.lower() for c in df.columns}
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c.lower() not in have])
        df.coalesce(2).write.parquet(f"{folder}/{name}")
    return str(folder)


def found(spark, query, folder):
    return sorted((tuple(r) for r in query(spark, folder).collect()), key=str)
