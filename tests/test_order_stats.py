import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, order_stats


def test_running_sums_equal_one_window(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame(list({(rng.choice(["a", "b", None]), rng.randrange(400)): None for _ in range(900)}), "k string, v int").withColumn("c", F.col("v") % 7 + 1)
    for keys in ([], ["k"]):
        base = rows if keys else rows.groupBy("v").agg(F.sum("c").alias("c"))
        for down in (False, True):
            w = Window.partitionBy(*keys).orderBy(F.desc("v") if down else F.asc("v"))
            want = base.withColumn("c_upto", F.sum("c").over(w))
            got = order_stats.running(base, keys, "v", ["c"], down, buckets=7)
            assert sorted(got.select(*want.columns).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.random(501).round(2).tolist(), "b": [0.5], "c": [1.0, 2.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)], "k string, v double")
    got = {r.k: r for r in order_stats.percentiles(rows, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert (got[k].p10, got[k].p50, got[k].p99) == pytest.approx(tuple(np.quantile(vs, [0.1, 0.5, 0.99])))
    r = order_stats.distribution_stats(rows, "v").first()
    every = [v for vs in values.values() for v in vs]
    assert (r.p25, r.p50, r.p75) == pytest.approx(tuple(np.quantile(every, [0.25, 0.5, 0.75])), abs=1e-6) and (r.min, r.max) == (min(every), max(every))
    assert order_stats.distribution_stats(rows.limit(0), "v").first().p50 is None


def test_no_task_orders_all_values(spark):
    """Two million distinct values of one group: the largest range holds a small part of them, and the median is right."""
    n = 2_000_000
    rows = spark.range(n, numPartitions=8).select(F.pmod(F.col("id") * 1_000_003, F.lit(n)).cast("double").alias("v"), F.lit(1).alias("c"))
    sizes = [r[1] for r in order_stats.bucketed(rows, [], "v", buckets=16).groupBy("__bucket").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == n and max(sizes) < 0.12 * n
    assert order_stats.percentiles(rows, [], "v", {"p": 0.5}).first().p == (n - 1) / 2


def test_ranked_metrics_over_ranges_of_scores(spark):
    rng = np.random.default_rng(5)
    score, label = rng.random(3000).round(3), (rng.random(3000) < 0.4).astype(float)
    rows = spark.createDataFrame([("t", float(y), float(s)) for y, s in zip(label, score)], "task string, label double, score double")
    pos, neg = score[label == 1], score[label == 0]
    auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    assert evaluate.ranked_metrics(rows).first().auc_roc == pytest.approx(auc, abs=1e-4)
