"""Session set-up and the shared folder that intermediate tables go to."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def build_session(app: str = "matchloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine's semantics rest on: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    return prepare(builder.config(map=defaults | conf).getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on, and see that Python workers can import the package.
    Timestamps without a zone mean UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Hand this package to the executors by way of the shared folder, once an
    application. A cluster without a shared folder must have the package installed."""
    sc = spark.sparkContext
    if getattr(sc, "_matchloom_shipped", False):
        return
    sc._matchloom_shipped = True
    if not sc.master.startswith("local") and not _configured(spark):
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    target = f"{shared_dir(spark)}/matchloom-{uuid.uuid4().hex[:12]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR, None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is read from the session; only a local
    master without the setting gets a temporary folder of its own."""
    path = _configured(spark)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR} to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="matchloom-")
    spark.conf.set(SHARED_DIR, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Unlike a cached table it survives the loss of any executor, and being columnar
    and compressed it needs less disk than an RDD checkpoint. It is deleted when the
    application ends, or by `discard` as soon as nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise wrote, once nothing reads it any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
