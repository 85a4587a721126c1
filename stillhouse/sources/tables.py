"""Reading the given tables and cutting long lineages through shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is a local one (tests) a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder; on a cluster intermediate tables need one")
        where = "file://" + tempfile.mkdtemp(prefix="stillhouse-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
