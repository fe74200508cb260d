"""Folders that driver and executors share, and checkpoints in them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, as in tests, a folder beside the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/{kind}/{uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder; sets a folder only where none is named."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
