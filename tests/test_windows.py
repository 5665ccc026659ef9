import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import timeseries


@pytest.fixture(scope="module")
def dense(spark):
    rng = random.Random(2)
    rows = [(c, date(2024, 1, 1) + timedelta(i), i + 1, rng.random() < 0.8, *(rng.choice([0.0, rng.random()]) for _ in range(2))) for c, n in (("a", 60), ("b", 7), ("c", 3), ("d", 24)) for i in range(n)]
    return spark.createDataFrame(rows, "country string, feature_date date, pos int, valid boolean, x double, y double").cache()


@pytest.mark.parametrize("seq_len, stride, least, chunk", [(5, 1, 0, 8), (7, 3, 2, 7), (5, 2, 4, 100), (1, 1, 0, 1)])
def test_windows_equal_one_frame_a_row(dense, seq_len, stride, least, chunk):
    w = Window.partitionBy("country").orderBy("pos").rowsBetween(-(seq_len - 1), 0)
    want = dense.select("country", F.col("feature_date").alias("end_date"), "pos", F.sum(F.when(F.col("x") + F.col("y") > 0, 1).otherwise(0)).over(w).alias("nonzero"), F.collect_list(F.struct("pos", "valid", "x", "y")).over(w).alias("window"))
    want = want.filter((F.col("pos") >= seq_len) & ((F.col("pos") - seq_len) % stride == 0) & (F.col("nonzero") >= least)).drop("pos")
    got = timeseries.sliding_windows(dense, ["x", "y"], seq_len, stride, least, chunk)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_rows_are_moved_about_once(dense):
    moved = timeseries.chunked(dense, ["x", "y"], 4, 20).agg(F.sum(F.size("rows"))).first()[0]
    assert dense.count() <= moved <= 1.25 * dense.count()  # a frame a row would copy each row five times
