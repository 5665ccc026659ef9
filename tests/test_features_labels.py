from datetime import date

from tidewatch.operators import features, labels, scoring, timeseries

E = "event_root_code int, event_base_code int, quad_class int, goldstein double, avg_tone double, num_mentions int, actor1_country string, actor2_country string, actor1_name string, actor2_name string, event_date date, action_geo_country string"
DAY = date(2024, 1, 5)


def events(spark, *rows):
    return spark.createDataFrame([(*r[:6], *(r[6:8] if len(r) > 6 else ("A", "B")), "n1", "n2", r[8] if len(r) > 8 else DAY, "US") for r in rows], E)


def test_shares(spark):
    r = features.daily_features(events(spark, (14, 140, 4, 0.0, 0.0, 1), (19, 190, 4, 0.0, 0.0, 1), (20, 200, 4, 0.0, 0.0, 1))).first()
    assert r.violence_score == 1.0 and r.protest_score == round(1 / 3, 6) and r.avg_goldstein == 0.5 and r.avg_sentiment == 0.5
    assert {"country", "feature_date", "total_events", "conflict_events", "cooperation_events", *features.SCORES} == set(r.asDict())


def test_nulls_and_range(spark):
    r = features.daily_features(events(spark, (None, None, None, None, None, None), (18, 180, 4, -10.0, -150.0, 1))).first()
    assert all(0 <= r[c] <= 1 for c in features.SCORES) and r.total_events == 2 and r.terrorism_score == 0.5


def test_clusters_and_pairs(spark):
    e = events(spark, (14, 141, 3, -4.0, -1.0, 30), (14, 141, 3, -4.0, -1.0, 20), (14, 141, 3, 9.0, 0.0, 5))
    r = features.event_clusters(e).first()
    assert (r.category, r.event_count, r.total_mentions, r.max_intensity) == ("protest", 3, 55, 9.0)
    p = features.top_actor_pairs(e)
    assert [(x.actor1, x.actor2, x.n) for x in p.first().pairs] == [("n1", "n2", 3)]
    assert features.merged_actor_pairs(features.pairs_json(p)).first().n == 3


def test_label_inequalities(spark):
    def signals(*rows):
        return labels.daily_signals(events(spark, *rows)).first()

    calm, riot, fight = signals((1, 10, 1, 5.0, 5.0, 10)), signals((14, 140, 4, -5.0, -5.0, 10)), signals((19, 190, 4, -9.0, -9.0, 50))
    assert calm.instability < riot.instability and calm.war < fight.war and riot.war < fight.war
    assert signals((18, 183, 4, -9.0, 0.0, 5)).terrorism > signals((18, 180, 4, -9.0, 0.0, 5)).terrorism > calm.terrorism
    assert signals((16, 163, 3, -4.0, -12.0, 5)).financial > calm.financial
    assert all(0 <= v <= 1 for v in fight[2:])


def test_context_smooths_only_two_tasks(spark):
    before = date(2024, 1, 3)
    alone = labels.multitask_labels(events(spark, (1, 10, 1, 5.0, 5.0, 10))).first()
    after = labels.multitask_labels(events(spark, (19, 190, 4, -9.0, -9.0, 50, "A", "B", before), (1, 10, 1, 5.0, 5.0, 10))).filter(f"label_date = '{DAY}'").first()
    assert after.instability_label > alone.instability_label and after.war_label > alone.war_label
    assert (after.terrorism_label, after.financial_label) == (alone.terrorism_label, alone.financial_label)


def test_dense_window_fills_inside_only(spark):
    f = spark.createDataFrame([("a", date(2024, 1, 1), 9.0), ("a", date(2024, 1, 4), 2.0), ("a", date(2024, 1, 6), 3.0)], "country string, feature_date date, v double")
    rows = timeseries.dense_window(f, ["v"], 5, "2024-01-07").orderBy("pos").collect()
    assert [(r.feature_date.day, r.v, r.valid) for r in rows] == [(3, 0.0, False), (4, 2.0, True), (5, 2.0, False), (6, 3.0, True), (7, 3.0, False)]


def test_trends(spark):
    up = spark.createDataFrame([("a", date(2024, 1, d), d / 40) for d in range(1, 21)], "country string, feature_date date, risk_score double")
    last = timeseries.trend_7v7(up).filter("feature_date = '2024-01-20'").first()
    assert last.trend == "increasing" and timeseries.trend_3v3(up).first().trend == "increasing"
    assert timeseries.trend_3v3(up.limit(4)).first().trend == "stable"


def test_attribution_is_complete(spark):
    w = {"protest_score": 0.3, "violence_score": 0.7}
    f = spark.createDataFrame([("a", 0.2, 0.4), ("a", 0.1, 0.9)], "country string, protest_score double, violence_score double")
    total = sum(r.contribution for r in scoring.attribute_features(f, w).collect())
    assert abs(total - (0.3 * 0.3 + 0.7 * 1.3)) < 1e-6
    zero = f.selectExpr("country", "0.0d as protest_score", "0.0d as violence_score")
    assert all(r.contribution == 0 for r in scoring.attribute_features(zero, w).collect())
