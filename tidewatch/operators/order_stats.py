"""Running sums and order statistics without one ordered task.

Rows are counted by distinct value, range-partitioned into buckets of neighbouring values, and summed by bucket. The sums of the
buckets before (a window over one row per bucket) and a window inside each bucket give each row's running sum, so a task orders
its own bucket only, however few the groups are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6
from tidewatch.sources.scratch import counted_broadcast, materialize


def bucketed(rows: DataFrame, keys: list[str], value: str, descending: bool = False, buckets: int | None = None) -> DataFrame:
    """``rows`` with ``__bucket``: buckets are ranges of (keys, value) in order; materialised."""
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(value) if descending else F.asc(value)
    return materialize(rows.repartitionByRange(n, *keys, order).withColumn("__bucket", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], value: str, sums: list[str], descending: bool = False, buckets: int | None = None) -> DataFrame:
    """``rows`` (distinct in keys and value) with ``<c>_upto`` for each of ``sums``: the sum over the rows of the same keys up to
    and with this one, by value."""
    b = bucketed(rows, keys, value, descending, buckets)
    totals = b.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("__bucket")
    starts = materialize(totals.select("__bucket", *[F.col(k).alias(f"__k_{k}") for k in keys], *[(F.sum(f"__t_{c}").over(before) - F.col(f"__t_{c}")).alias(f"__s_{c}") for c in sums]))
    same = F.col("__b") == F.col("__bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy("__b", *keys).orderBy(F.desc(value) if descending else F.asc(value))
    own = b.withColumnRenamed("__bucket", "__b").select("*", *[F.sum(c).over(inside).alias(f"__o_{c}") for c in sums])
    return own.join(counted_broadcast(starts), same).select(*rows.columns, *[(F.col(f"__o_{c}") + F.col(f"__s_{c}")).alias(f"{c}_upto") for c in sums])


def _counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(F.sum("__c").alias("__n"))


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n and one column for each of ``ranks``: the value with that rank (from 1; an expression of ``n``) within the keys."""
    counts = materialize(_counts(rows, keys, value))
    along = running(counts, keys, "__v", ["__c"])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__g_{k}"))
    j = along.join(F.broadcast(_totals(counts, keys)) if not keys else _totals(counts, keys), same).withColumnRenamed("__n", "n")
    hit = {name: (rank > F.col("__c_upto") - F.col("__c")) & (rank <= F.col("__c_upto")) for name, rank in ranks.items()}
    some = F.lit(False)
    for h in hit.values():
        some = some | h
    return j.filter(some).groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(h, F.col("__v"))).alias(name) for name, h in hit.items()])


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and one column for each of ``shares``: the exact percentile, between neighbours in proportion; nulls don't count."""
    ranks = {}
    for name, q in shares.items():
        place = (F.col("n") - 1) * F.lit(float(q))
        ranks |= {f"__lo_{name}": F.floor(place) + 1, f"__hi_{name}": F.ceil(place) + 1}
    found = at_ranks(rows, keys, value, ranks)
    part = lambda q: (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
    return found.select(*keys, *[(F.col(f"__lo_{name}") * (1 - part(q)) + F.col(f"__hi_{name}") * part(q)).alias(name) for name, q in shares.items()])


def distribution_stats(rows: DataFrame, column: str) -> DataFrame:
    """One row: mean, std, min, p25, p50, p75, max; nulls of an empty table."""
    p = percentiles(rows, [], column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    whole = rows.agg(r6(F.avg(column)).alias("mean"), r6(F.stddev_pop(column)).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    both = whole.join(F.broadcast(p), F.lit(True), "left")
    return both.select("mean", "std", "min", r6(F.col("p25")).alias("p25"), r6(F.col("p50")).alias("p50"), r6(F.col("p75")).alias("p75"), "max")
