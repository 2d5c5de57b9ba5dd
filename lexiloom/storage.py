"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="lexiloom-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table made by ``write_table`` that a later one replaces."""
    if not path.startswith(f"{scratch_dir(spark)}/lexiloom/"):
        raise ValueError(f"not an intermediate table: {path}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
