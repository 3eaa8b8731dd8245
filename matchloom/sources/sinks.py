"""Sinks and the catalog: tables, views, result formats, schema documents."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists", codec: str = "zstd") -> None:
    """Compressed Parquet. The writer's parallelism is the plan's own."""
    w = df.write.mode(mode).option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by keys, so that later joins and groupings on them
    need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("compression", "zstd").saveAsTable(name)


def create_table(df: DataFrame, name: str, drop: bool = True) -> None:
    df.write.mode("overwrite" if drop else "errorifexists").saveAsTable(name)


def append_by_name(df: DataFrame, name: str) -> None:
    """Append to a table by column name; columns that df lacks are null."""
    have = df.sparkSession.table(name)
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in have.schema.fields]
    df.select(*cols).write.mode("append").insertInto(name)


def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, is_temporary boolean")


def describe(df: DataFrame) -> DataFrame:
    """position, column_name, dtype, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string, nullable boolean")


def engine_info(spark: SparkSession) -> DataFrame:
    """name, value: version, default parallelism, database and the settings results rest on."""
    keys = ["spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"]
    rows = [("version", spark.version), ("database", spark.catalog.currentDatabase()), ("parallelism", str(spark.sparkContext.defaultParallelism))]
    return spark.createDataFrame(rows + [(k, str(spark.conf.get(k))) for k in keys], "name string, value string")


def row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, n_rows, as one job over all tables."""
    out: DataFrame | None = None
    for n in names:
        part = spark.table(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "table_name string, n_rows bigint")


def render(df: DataFrame, form: str = "table", most: int | None = None) -> str:
    """A result as text: table, csv or json (records). All of it: a result of more than
    `most` rows, where that is given, is an error, never cut."""
    pdf = (df if most is None else df.limit(most + 1)).toPandas()
    if most is not None and len(pdf) > most:
        raise ValueError(f"the result has more than {most} rows")
    if form == "csv":
        return pdf.to_csv(index=False)
    if form == "json":
        return json.dumps(json.loads(pdf.to_json(orient="records", date_format="iso")), ensure_ascii=False)
    if form != "table":
        raise ValueError(f"unknown format {form}")
    return pdf.to_string(index=False)


def write_artifact(df: DataFrame, path: str, sql: str | None = None) -> None:
    """A small result as JSON together with what produced it: the SQL given, or the
    optimised plan."""
    plan = sql or df._jdf.queryExecution().optimizedPlan().toString()
    with open(path, "w") as f:
        json.dump({"query": plan, "rows": json.loads(render(df, "json"))}, f, ensure_ascii=False, indent=1)


def _quoted(s: str) -> str:
    return s if re.fullmatch(r"[A-Za-z_][\w.<>,()]*", s) else json.dumps(s)


def schema_yaml(df: DataFrame, name: str, old: str | None = None, n_rows: int | None = None) -> str:
    """A YAML document of a table's columns. Descriptions written by people into an
    earlier version of the document are kept."""
    kept = dict(re.findall(r"- name: (\S+)\n(?:    .*\n)*?    description: (.+)\n", (old or "") + "\n"))
    lines = [f"table: {_quoted(name)}"] + ([f"row_count: {n_rows}"] if n_rows is not None else []) + ["columns:"]
    for f in df.schema.fields:
        lines += [f"  - name: {_quoted(f.name)}", f"    type: {_quoted(f.dataType.simpleString())}", f"    nullable: {str(f.nullable).lower()}"]
        if _quoted(f.name) in kept:
            lines.append(f"    description: {kept[_quoted(f.name)]}")
    return "\n".join(lines) + "\n"


def export_schemas(spark: SparkSession, names: list[str], folder: str) -> list[str]:
    """One YAML per table and an index; existing descriptions survive."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for n in names:
        path = os.path.join(folder, f"{n}.yaml")
        old = open(path).read() if os.path.exists(path) else None
        with open(path, "w") as f:
            f.write(schema_yaml(spark.table(n), n, old))
        out.append(path)
    with open(os.path.join(folder, "_index.yaml"), "w") as f:
        f.write("tables:\n" + "".join(f"  - {_quoted(n)}\n" for n in sorted(names)))
    return out
