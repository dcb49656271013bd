"""Session, shared scratch folder and materialised intermediate tables.

Intermediate results that cut a lineage are Parquet tables in the folder that the cluster
names in ``spark.checkpoint.dir``; every executor and the driver can read them, so losing an
executor never loses one. Only in local mode (tests) a local folder is made where that is unset.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder made where the session names none.
_own_dir: list[str] = []


def build_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. In local mode, where none is configured, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tidewell-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        base = _own_dir[0]
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder; return it reread, and its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system (local, HDFS or object store)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
