"""Intermediate tables in the folder that driver and executors share, and joins by a counted size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a local folder, and anything else raises, as each
    executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and a lost executor costs a reread."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` of a join that grows with the input: never broadcast. Catalyst would take it for small, as it goes by the size
    of compressed files and a share of it for each column read."""
    return side.hint("merge")


def counted_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` (materialised) marked for broadcast if it counts at most ``rows`` rows, else never broadcast."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else shuffled(small)
