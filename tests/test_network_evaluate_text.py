from datetime import date

import pytest

from tidewatch.operators import evaluate, network, text


def test_adjacency(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("a", "c", 0.1), ("a", "zz", 0.9)], "country_a string, country_b string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "country string")
    rows = {(r.src, r.dst): r.w for r in network.normalised_adjacency(edges, nodes, 0.2).collect()}
    assert set(rows) == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")} and rows["a", "b"] == pytest.approx(0.7 / 1.7) and rows["c", "c"] == 1.0
    bare = network.normalised_adjacency(edges, nodes, 0.2, self_loops=False).groupBy("src").sum("w").collect()
    assert {r[0]: r[1] for r in bare} == {"a": 1.0, "b": 1.0}


def test_spillover(spark):
    corr = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.9)], "country_a string, country_b string, correlation double")
    cooc = spark.createDataFrame([("a", "b", 9), ("b", "c", 4)], "country_a string, country_b string, events long")
    adj = spark.createDataFrame([("a", "c")], "country_a string, country_b string")
    rows = network.spillover_edges(corr, cooc, adj).collect()
    assert [(r.country_a, r.country_b) for r in rows] == [("a", "b"), ("a", "c"), ("b", "c")] and rows[0].weight == 0.75 and rows[1].weight == 0.6
    assert network.spillover_edges(corr, cooc, adj, 1).count() == 1 and network.spillover_edges(corr.limit(0), cooc.limit(0), adj).count() == 0


def test_conformal_order_statistic(spark):
    rows = [("c", date(2024, 1, 1), 14, 0.1, 0.0, 0.0, 1.0, i / 10) for i in range(1, 10)]
    s = spark.createDataFrame(rows, "country string, pivot_date date, horizon_days int, origin_risk double, predicted double, lower double, upper double, actual double")
    q = {r.level: r.q for r in evaluate.conformal_quantiles(s, 0.2).collect()}
    assert q == {"global": 0.8, "horizon": 0.8}
    c = evaluate.calibrated(s, evaluate.conformal_quantiles(s, 0.2)).first()
    assert (c.lower, c.upper) == (0.0, 0.8)


def test_ranked_metrics(spark):
    rows = spark.createDataFrame([("t", y, s) for y, s in ((1.0, 0.9), (0.0, 0.9), (1.0, 0.6), (0.0, 0.2))], "task string, label double, score double")
    r = evaluate.ranked_metrics(rows).first()
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a in (0.9, 0.6) for b in (0.9, 0.2)]
    assert r.auc_roc == sum(pairs) / 4 and r.f1 == 0.8
    assert evaluate.ranked_metrics(rows.filter("label = 1")).first().auc_roc is None


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "military mobilization at the border"), (2, "peaceful trade talks"), (3, "border military drills")], "id long, text string")
    q = spark.createDataFrame([(7, "military border border"), (8, "zzz")], "q long, text string")
    rows = text.retrieve(text.tfidf_index(docs, "id"), q, "id", "q", k=2).collect()
    assert {r.id for r in rows} == {1, 3} and all(r.similarity >= 0.05 and r.q == 7 for r in rows)
    assert text.retrieve(text.tfidf_index(docs.limit(0), "id"), q, "id", "q").collect() == []


@pytest.mark.parametrize("score,level", [(0.80, "CRITICAL"), (0.79, "HIGH"), (0.65, "HIGH"), (0.50, "ELEVATED"), (0.35, "MODERATE"), (0.34, "LOW")])
def test_advisory(spark, score, level):
    s = spark.createDataFrame([("X", score, "increasing", 0.8, 0.72, 0.5, 0.1, 0.5, 0.9)], "country string, risk_score double, trend string, instability double, war double, terrorism double, financial double, protest_score double, violence_score double")
    r = text.rule_advisory(s).first()
    assert r.level == level and r.advisory_text.startswith(f"{level} RISK") and r.advisory_text.count("military") == 1 and "↑" in r.short_summary
    assert text.major_drivers(s).first().drivers == ["Material conflict events", "Political instability", "Military / armed conflict risk"]


def test_rolling_spillover_sees_no_later_event(spark):
    """As of each date the same as computing that date alone, and blind to what comes after it."""
    from datetime import timedelta
    import random

    from pyspark.sql import functions as F

    rng, day = random.Random(4), date(2024, 1, 1)
    names = ["a", "b", "c", "d"]
    events = [(day + timedelta(rng.randrange(20)), rng.choice(names), rng.choice([*names, None]), rng.choice([1, 3, 4, None])) for _ in range(900)]
    risks = [(n, day + timedelta(i), round(rng.random(), 6) if n != "d" else 0.5) for n in names for i in range(20) if rng.random() < 0.8]
    e = spark.createDataFrame(events, "event_date date, actor1_country string, actor2_country string, quad_class int")
    r = spark.createDataFrame(risks, "country string, feature_date date, risk_score double")
    adj = spark.createDataFrame([("a", "b")], "country_a string, country_b string")
    key = lambda rows: sorted(tuple(x) for x in rows)
    start, end = day + timedelta(8), day + timedelta(14)
    both = lambda e, r: (network.rolling_correlations(r, str(start), str(end), 6, 4), network.rolling_cooccurrence(e, str(start), str(end), 6, 3))
    rolled = network.rolling_spillover(*both(e, r), adj)
    early = network.rolling_spillover(*both(e.filter(F.col("event_date") <= end), r.filter(F.col("feature_date") <= end)), adj)
    got = rolled.collect()
    assert key(got) == key(early.collect()) and len({x.as_of for x in got}) == 7
    for i in (0, 3, 6):
        d = start + timedelta(i)
        c, o = network.risk_correlations(r, str(d), 6, 4), network.cooccurrence(e, str(d - timedelta(6)), str(d), 3)
        assert {(x.country_a, x.country_b) for x in c.collect()} <= {("a", "b"), ("a", "c"), ("b", "c")}
        assert key(network.spillover_edges(c, o, adj).collect()) == key(tuple(x)[1:] for x in got if x.as_of == d)
    assert network.rolling_spillover(*both(e.limit(0), r.limit(0)), adj).collect() == []


def test_cooccurrence_counts_all_days(spark):
    events = [(date(2024, 1, d), "a", "b", 3) for d in (1, 2, 25)]
    e = spark.createDataFrame(events, "event_date date, actor1_country string, actor2_country string, quad_class int")
    assert [tuple(r) for r in network.cooccurrence(e, min_events=3).collect()] == [("a", "b", 3)]
    assert network.cooccurrence(e, "2024-01-02", "2024-01-30", 3).collect() == []


def test_network_queries_see_events_of_every_day(spark, tmp_path):
    """Conflicts of the first days alone make edges."""
    import shutil

    from tidewatch.plans import catalog_models

    sf = "/root/testdata/sf0.001"
    shutil.copy(f"{sf}/nation.parquet", tmp_path)
    spark.read.parquet(f"{sf}/events.parquet").filter("ts < '2024-01-06'").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: catalog_models.QUERIES[name](spark, str(tmp_path)).count()
    assert run("g18_cooccurrence") > 0 and run("j6_spillover_edges") > 0
