"""Append of new events against a long history: a Bloom sketch for each month decides which months and keys are looked at.

Facts are a versioned table by month. Beside it stands one of sketches: for each month, words of 64 bits of a bit field of
``BITS`` bits, in which each key sets ``HASHES`` bits. Sketches are merged by ``bit_or``, so each batch only adds its own words.
A key of which a bit is missing is new. The others are looked up exactly, in the months where there are any; months without
one are not read. A sketch is committed before its facts, so it never lacks a key that is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from tidewatch.sources.scratch import BROADCAST_ROWS, materialize, shuffled
from tidewatch.sources.versioned import VersionedTable

#: For a month of about a million keys; with a multiple of them more keys are looked up exactly, none is missed.
BITS, HASHES = 1 << 24, 5
KEYS = ("global_event_id", "event_date")
MONTH = "event_month"


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def _bits(keys: tuple[str, ...], bits: int) -> Column:
    """word and bit of each of a key's places."""
    places = [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(bits)) for i in range(HASHES)]
    return F.array(*[F.struct(F.floor(p / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")).alias("bit")) for p in places])


def sketch(rows: DataFrame, keys: tuple[str, ...] = KEYS, bits: int = BITS) -> DataFrame:
    """event_month, word, bits: the sketch of the rows' keys."""
    each = rows.select(MONTH, F.explode(_bits(keys, bits)).alias("b")).select(MONTH, "b.*")
    return each.groupBy(MONTH, "word").agg(F.bit_or("bit").alias("bits"))


class History:
    """Facts and sketches under one path."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS, bits: int = BITS):
        self.spark, self.keys, self.bits = spark, keys, bits
        self.facts = VersionedTable(spark, f"{path}/facts", [MONTH])
        self.sketches = VersionedTable(spark, f"{path}/sketches", [MONTH])
        #: months and keys of the last append that were looked up exactly
        self.looked_up: tuple[list[str], int] = ([], 0)

    def read(self) -> DataFrame | None:
        rows = self.facts.read()
        return rows.drop(MONTH) if rows is not None else None

    def suspected(self, rows: DataFrame) -> DataFrame:
        """Rows (keys, each once, and event_month) of which all bits are set."""
        known = self.sketches.read()
        if known is None:
            return rows.limit(0)
        months = [r[0] for r in rows.select(MONTH).distinct().collect()]
        merged = known.filter(F.col(MONTH).isin(months)).groupBy(MONTH, "word").agg(F.bit_or("bits").alias("bits"))
        places = rows.select(MONTH, *self.keys, F.array_distinct(_bits(self.keys, self.bits)).alias("places"))
        asked = places.select(MONTH, *self.keys, F.size("places").alias("all"), F.explode("places").alias("b")).select(MONTH, *self.keys, "all", "b.*")
        hit = asked.join(shuffled(merged), [MONTH, "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return hit.groupBy(MONTH, *self.keys, "all").agg(F.count("*").alias("n")).filter("n = all").select(MONTH, *self.keys)

    def append(self, events: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Append the events whose keys are new, once each; how many. A batch that the log has adds nothing."""
        state = self.facts.state()
        if stream is not None and state["batches"].get(stream, -1) >= batch:
            return 0
        rows = materialize(events.dropDuplicates(list(self.keys)).withColumn(MONTH, month_of(F.col("event_date"))))
        maybe = materialize(self.suspected(rows.select(MONTH, *self.keys)))
        months = sorted(r[0] for r in maybe.select(MONTH).distinct().collect())
        n = maybe.count() if months else 0
        self.looked_up = (months, n)
        fresh = rows
        if months:
            there = self.facts.read().filter(F.col(MONTH).isin(months)).select(*self.keys)
            if n <= BROADCAST_ROWS:
                there = F.broadcast(there.join(F.broadcast(maybe.select(*self.keys)), list(self.keys), "left_semi"))
            fresh = rows.join(there if n <= BROADCAST_ROWS else shuffled(there), list(self.keys), "left_anti")
        seen = Observation(f"append_{uuid.uuid4().hex}")
        fresh = materialize(fresh.observe(seen, F.count(F.lit(1)).alias("n")))
        self.sketches.append(sketch(fresh, self.keys, self.bits))
        self.facts.append(fresh, stream, batch)
        return int(seen.get["n"])
