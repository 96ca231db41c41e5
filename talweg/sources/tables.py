"""Reading the Parquet tables of a data folder, and tables of our own in the shared one."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Without that setting, a local session gets one of this
    machine; on a cluster, whose executors would each write to a disk of their own, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(found or _local_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@lru_cache(1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="talweg-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written in the shared folder and read again: what uses it more than once doesn't make it more than once."""
    df.write.parquet(path := shared_folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
