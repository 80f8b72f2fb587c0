"""Session-level helpers: shipping the package, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
    # The archive lies in the shared folder, so executors that join later find it, too.
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/code-{uuid.uuid4().hex}/{PACKAGE.name}_src.zip")
    out = path.getFileSystem(conf).create(path)
    out.write(bytearray(buf.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir. Where that is unset, a temporary folder serves if all of Spark is
    this one process; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"sievegrid-{spark.sparkContext.applicationId}")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that `materialize` wrote for this application; for when their queries are over. Returns their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def broadcast_if_small(df: DataFrame, n_rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """A broadcast hint only when the counted rows prove the size; otherwise Catalyst picks a shuffled join."""
    return F.broadcast(df) if n_rows * row_bytes <= limit else df


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are over; it does so when the driver's JVM collects their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
