"""Tables that live for one run in the folder that all nodes share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset a local folder, which one machine
    alone can use: a cluster without the setting is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes of {spark.sparkContext.master} share")
        found = getattr(spark, "_tessera_dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark._tessera_dir = found
    return found


def run_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes when the session ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage and survives lost executors. With ``free`` the files of the write's own shuffles
    go as soon as it is done, not when the session gets to it.
    """
    path, conf = run_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if free:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
