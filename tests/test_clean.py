from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import clean
from tidewatch.plans import fixtures

RAW = "global_event_id string, sqldate string, goldstein_scale string, num_mentions string, event_root_code string, quad_class string, avg_tone string, action_geo_country_code string, source_url string"


def raw(spark, *rows):
    return spark.createDataFrame(rows, RAW)


def test_valid_row(spark):
    r = clean.parse_events(raw(spark, ("7", "20240105", "-3.5", "14.0", "14", "3", "-1.25", " US ", "http://x"))).first()
    assert (r.global_event_id, r.event_date, r.goldstein, r.num_mentions, r.event_root_code, r.action_geo_country) == (7, date(2024, 1, 5), -3.5, 14, 14, "US")


@pytest.mark.parametrize("row", [("7", "", *[""] * 7), ("7", "20241399", *[""] * 7), ("7", "2024015", *[""] * 7), ("x", "20240105", *[""] * 7), ("0", "20240105", *[""] * 7), (None, "20240105", *[None] * 7)])
def test_skipped_rows(spark, row):
    assert clean.parse_events(raw(spark, row)).count() == 0
    r = clean.parse_counts(raw(spark, row)).first()
    assert (r.n_parsed, r.n_skipped) == (0, 1)


def test_clamp_and_empties(spark):
    rows = clean.parse_events(raw(spark, ("1", "20240101", "55", "", "", "", "x", "", ""), ("2", "20240101", "-55", None, "a", "1.9", "", "", ""))).orderBy("global_event_id").collect()
    assert [r.goldstein for r in rows] == [10.0, -10.0] and [r.num_mentions for r in rows] == [0, 0]
    assert rows[0].event_root_code is None and rows[0].avg_tone is None and rows[1].quad_class == 1


def test_rejections_codes_and_values(spark):
    e = spark.createDataFrame(
        [(1, date(2024, 1, 1), "us", "u" * 3000, 95.0, 10.0), (2, date(2019, 1, 1), "us", "", 1.0, 1.0), (3, date(2024, 1, 1), " ", "", 1.0, 1.0), (4, None, "us", "", 1.0, 1.0)],
        "global_event_id long, event_date date, action_geo_country string, source_url string, latitude double, longitude double")
    why = {r.global_event_id: r.rejected for r in clean.with_rejection(e, "2020-01-01").collect()}
    assert why == {1: None, 2: "too_early", 3: "no_country", 4: "no_key"}
    r = clean.tidy_values(clean.normalise_countries(clean.valid_events(e, "2020-01-01"), spark.createDataFrame([("US", "USA")], "code string, iso string"), ("action_geo_country",))).first()
    assert (r.action_geo_country, len(r.source_url), r.latitude, r.longitude) == ("USA", 2048, None, 10.0)


def test_dedup(spark):
    e = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 1, "c")], "global_event_id long, arrival long, v string")
    assert sorted(r.v for r in clean.first_by_id(e).collect()) == ["a", "c"]
    assert [r.v for r in clean.unseen(e, e.filter("v = 'a'")).collect()] == ["c"]


@pytest.mark.parametrize("root,base,quad,expected", [(18, 180, 4, "terrorism"), (20, 200, 4, "terrorism"), (19, 190, 3, "military"), (15, 150, 4, "military"), (14, 141, 3, "protest"), (16, 163, 3, "sanctions"), (17, 168, 4, "sanctions"), (None, None, None, "diplomatic")])
def test_categories(spark, root, base, quad, expected):
    e = spark.createDataFrame([(root, base, quad)], "event_root_code int, event_base_code int, quad_class int")
    assert clean.classified(e).first().category == expected


def test_anchored_range(spark):
    d = spark.createDataFrame([("a", date(2024, 1, 10)), ("a", date(2024, 1, 2)), ("b", date(2023, 5, 5))], "k string, d date")
    assert sorted((r.k, r.d.day) for r in clean.anchored_range(d, "k", "d", 7).collect()) == [("a", 10), ("b", 5)]


def test_filters_reach_the_scan(spark):
    f = fixtures.table(spark, "/root/testdata/sf0.001", "lineitem").filter("l_quantity > 49").select("l_orderkey")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan and "l_comment" not in plan
    assert f.filter(F.col("l_orderkey") < 0).count() == 0
