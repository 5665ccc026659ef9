"""What the training-data operators share: table access, shared storage, sized joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side of a join is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 100_000

#: Characters of text that a block of rows has at most, about.
BLOCK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local master gets a local folder; on a cluster, where each executor would write to
    its own disk, that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has a scan as its whole lineage, so a lost executor costs a reread, and a frame that is
    used twice is computed once. ``drop`` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` made and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            if fs.makeQualified(p.getParent()).equals(fs.makeQualified(root)):
                fs.delete(p, True)


def sized_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a materialised ``small`` side: broadcast if it counts at most ``rows`` rows, else shuffled.

    Keys are compared null-safely; the result has the columns of ``large`` and the non-key ones of ``small``.
    """
    side = small.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(on)], *[c for c in small.columns if c not in on])
    side = F.broadcast(side) if small.limit(rows + 1).count() <= rows else side
    condition = None
    for i, k in enumerate(on):
        c = large[k].eqNullSafe(F.col(f"__key_{i}"))
        condition = c if condition is None else condition & c
    return large.join(side, condition, how).drop(*[f"__key_{i}" for i in range(len(on))])


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def blocks(batch: pa.RecordBatch, limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``limit`` characters at most, one row at least."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
