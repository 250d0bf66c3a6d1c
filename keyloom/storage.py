"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a
    session on one machine may leave it unset; it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start
    from files that outlive any executor, and the plan starts afresh. The files
    go when the session ends, or with the table that is made ``instead_of``
    them, which may be read while that is written but not after."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _path(spark, path)
    files.deleteOnExit(where)
    if instead_of is not None:
        for old in {f.rsplit("/", 1)[0] for f in instead_of.inputFiles()}:
            files, where = _path(spark, old)
            files.delete(where, True)
    return spark.read.schema(df.schema).parquet(path)
