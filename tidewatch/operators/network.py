"""The country network: correlations, co-occurrence, adjacency and spread of risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where one of the two is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def risk_correlations(risk: DataFrame, as_of: str, window: int = 90, min_overlap: int = 30) -> DataFrame:
    """Pearson correlation of each country pair over the days that both have; a < b. A self-join on the day."""
    day = F.lit(as_of).cast("date")
    r = risk.filter(F.col("feature_date").between(F.date_sub(day, window), day) & F.col("risk_score").isNotNull()).select("country", "feature_date", "risk_score")
    a = r.select(F.col("country").alias("country_a"), "feature_date", F.col("risk_score").alias("x"))
    b = r.select(F.col("country").alias("country_b"), F.col("feature_date").alias("d"), F.col("risk_score").alias("y"))
    pairs = a.join(b, (F.col("feature_date") == F.col("d")) & (F.col("country_a") < F.col("country_b")))
    g = pairs.groupBy("country_a", "country_b").agg(F.count("*").alias("overlap"), _correlation("x", "y").alias("c"))
    return g.filter((F.col("overlap") >= min_overlap) & F.col("c").isNotNull() & ~F.isnan("c")).select("country_a", "country_b", "overlap", r6(F.col("c")).alias("correlation"))


def _conflict_pairs(events: DataFrame) -> DataFrame:
    """Conflict events between two different countries."""
    a, b = F.col("actor1_country"), F.col("actor2_country")
    return events.filter(F.col("quad_class").isin(3, 4) & a.isNotNull() & b.isNotNull() & (a != b))


def _folded(directed: DataFrame, *keys: str) -> DataFrame:
    return directed.groupBy(*keys, F.least("actor1_country", "actor2_country").alias("country_a"), F.greatest("actor1_country", "actor2_country").alias("country_b")).agg(F.sum("n").alias("events"))


def cooccurrence(events: DataFrame, start: str | None = None, end: str | None = None, min_events: int = 5) -> DataFrame:
    """Conflict events between two countries, of all days or of those from ``start`` to ``end``: directed counts of at least ``min_events``, then folded."""
    if start:
        events = events.filter(F.col("event_date") >= F.lit(start).cast("date"))
    if end:
        events = events.filter(F.col("event_date") <= F.lit(end).cast("date"))
    return _folded(_conflict_pairs(events).groupBy("actor1_country", "actor2_country").agg(F.count("*").alias("n")).filter(F.col("n") >= min_events))


def _rolled(daily: DataFrame, keys: list[str], date: str, start: str, end: str, days: int) -> DataFrame:
    """keys, as_of and the sums of the other columns of ``daily`` (one row per key and date) over ``days`` before each date of
    the range and that date itself. A key's window holds its dates and the range's, never its events."""
    sums = [c for c in daily.columns if c not in (*keys, date)]
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    near = daily.filter(F.col(date).between(F.date_sub(first, days), last))
    rows = near.select(*keys, F.col(date).alias("as_of"), F.lit(False).alias("asked"), *sums)
    marks = near.select(*keys).distinct().select(*keys, F.explode(F.sequence(first, last)).alias("as_of"), F.lit(True).alias("asked"), *[F.lit(0).cast(daily.schema[c].dataType).alias(c) for c in sums])
    w = Window.partitionBy(*keys).orderBy(F.unix_date("as_of")).rangeBetween(-days, 0)
    return rows.unionByName(marks).select(*keys, "as_of", "asked", *[F.sum(c).over(w).alias(c) for c in sums]).filter("asked").drop("asked")


def rolling_correlations(risk: DataFrame, start: str, end: str, days: int = 90, min_overlap: int = 30) -> DataFrame:
    """``risk_correlations`` as of each date from ``start`` to ``end``: as_of, country_a, country_b, overlap, correlation.

    Each pair's days become one row of counts and products, whose sums roll along. Risks are taken in millionths, so the
    sums are whole numbers and don't lose digits as days leave the window.
    """
    r = risk.filter(F.col("risk_score").isNotNull()).select("country", "feature_date", F.round(F.col("risk_score") * 1_000_000).cast("long").alias("v"))
    a, b = r.select(F.col("country").alias("country_a"), "feature_date", F.col("v").alias("x")), r.select(F.col("country").alias("country_b"), F.col("feature_date").alias("d"), F.col("v").alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = a.join(b, (F.col("feature_date") == F.col("d")) & (F.col("country_a") < F.col("country_b"))).select(
        "country_a", "country_b", "feature_date", F.lit(1).cast("long").alias("n"), "x", "y", (x * y).alias("xy"), (x * x).alias("xx"), (y * y).alias("yy"))
    s = _rolled(pairs, ["country_a", "country_b"], "feature_date", start, end, days).filter(F.col("n") >= min_overlap)
    n = F.col("n")
    var_x, var_y = n * F.col("xx") - x * x, n * F.col("yy") - y * y
    c = (n * F.col("xy") - x * y) / (F.sqrt(var_x.cast("double")) * F.sqrt(var_y.cast("double")))
    return s.filter((var_x > 0) & (var_y > 0)).select("as_of", "country_a", "country_b", n.alias("overlap"), r6(c).alias("correlation"))


def rolling_cooccurrence(events: DataFrame, start: str, end: str, days: int = 90, min_events: int = 5) -> DataFrame:
    """``cooccurrence`` of the ``days`` up to each date from ``start`` to ``end``: as_of, country_a, country_b, events."""
    daily = _conflict_pairs(events).groupBy("actor1_country", "actor2_country", "event_date").agg(F.count("*").alias("n"))
    return _folded(_rolled(daily, ["actor1_country", "actor2_country"], "event_date", start, end, days).filter(F.col("n") >= min_events), "as_of")


def rolling_spillover(correlations: DataFrame, cooccurring: DataFrame, adjacent: DataFrame, limit: int = 500) -> DataFrame:
    """``spillover_edges`` of each as_of: co-occurrence in proportion to the date's largest, the ``limit`` heaviest a date."""
    keys = ["as_of", "country_a", "country_b"]
    top = F.max(F.log1p("events")).over(Window.partitionBy("as_of"))
    c = cooccurring.select(*keys, F.when(top > 0, F.log1p("events") / top).otherwise(0.0).alias("cooc"))
    j = correlations.select(*keys, "correlation").join(c, keys, "full").join(adjacent.select("country_a", "country_b", F.lit(True).alias("adj")), ["country_a", "country_b"], "left")
    heaviest = Window.partitionBy("as_of").orderBy(F.desc("weight"), "country_a", "country_b")
    return _weighted_edges(j, "as_of").withColumn("r", F.row_number().over(heaviest)).filter(F.col("r") <= limit).drop("r")


def _weighted_edges(j: DataFrame, *keys: str) -> DataFrame:
    """Weight from correlation and co-occurrence, either of which may be null, with a bonus for neighbours."""
    base = 0.5 * F.abs(F.coalesce("correlation", F.lit(0.0))) + 0.5 * F.coalesce("cooc", F.lit(0.0))
    return j.select(
        *keys, "country_a", "country_b", r6(F.coalesce("correlation", F.lit(0.0))).alias("correlation"), r6(F.coalesce("cooc", F.lit(0.0))).alias("cooccurrence"),
        F.coalesce("adj", F.lit(False)).alias("is_adjacent"), r6(F.when(F.col("adj"), F.least(base + 0.15, F.lit(1.0))).otherwise(base)).alias("weight"))


def spillover_edges(correlations: DataFrame, cooccurring: DataFrame, adjacent: DataFrame, limit: int = 500) -> DataFrame:
    """Weight from correlation and co-occurrence, with a bonus for neighbours; the ``limit`` heaviest."""
    top = cooccurring.agg(F.max(F.log1p("events"))).scalar()
    c = cooccurring.withColumn("cooc", F.when(top > 0, F.log1p("events") / top).otherwise(0.0))
    j = correlations.select("country_a", "country_b", "correlation").join(c.select("country_a", "country_b", "cooc"), ["country_a", "country_b"], "full")
    j = j.join(adjacent.select("country_a", "country_b", F.lit(True).alias("adj")), ["country_a", "country_b"], "left")
    return _weighted_edges(j).orderBy(F.desc("weight"), "country_a", "country_b").limit(limit)


def correlation_edges(risk: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Signed correlations of countries that are present on every date."""
    n_dates = risk.agg(F.count_distinct("feature_date")).scalar()
    full = risk.groupBy("country").agg(F.count_distinct("feature_date").alias("n")).filter(F.col("n") == n_dates).select("country")
    r = risk.join(full, "country").select("country", "feature_date", "risk_score")
    a = r.select(F.col("country").alias("country_a"), "feature_date", F.col("risk_score").alias("x"))
    b = r.select(F.col("country").alias("country_b"), F.col("feature_date").alias("d"), F.col("risk_score").alias("y"))
    g = a.join(b, (F.col("feature_date") == F.col("d")) & (F.col("country_a") < F.col("country_b"))).groupBy("country_a", "country_b").agg(r6(_correlation("x", "y")).alias("weight"))
    return g.filter(F.abs("weight") >= threshold)


def normalised_adjacency(edges: DataFrame, nodes: DataFrame, min_weight: float = 0.0, self_loops: bool = True) -> DataFrame:
    """src, dst, w: symmetric by the larger weight, known nodes only, rows summing to 1."""
    e = edges.filter(F.col("weight") >= min_weight)
    both = e.select(F.col("country_a").alias("src"), F.col("country_b").alias("dst"), "weight").union(e.select("country_b", "country_a", "weight"))
    known = nodes.select("country").distinct()
    both = both.join(known.withColumnRenamed("country", "src"), "src", "left_semi").join(known.withColumnRenamed("country", "dst"), "dst", "left_semi")
    m = both.select("src", "dst", "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    if self_loops:
        m = m.filter("src <> dst").unionByName(known.select(F.col("country").alias("src"), F.col("country").alias("dst"), F.lit(1.0).alias("weight")))
    total = m.groupBy("src").agg(F.sum("weight").alias("total"))
    return m.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("w"))


def neighbour_enrichment(adjacency: DataFrame, nodes: DataFrame, columns: list[str], hops: int = 1) -> DataFrame:
    """Weighted means of the neighbours' columns, repeated ``hops`` times: country and n_<column>."""
    state = nodes.select("country", *columns)
    for _ in range(hops):
        j = adjacency.join(state.withColumnRenamed("country", "dst"), "dst")
        state = j.groupBy("src").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns]).withColumnRenamed("src", "country")
    return state.select("country", *[r6(F.col(c)).alias(f"n_{c}") for c in columns])


def network_adjusted_risk(nodes: DataFrame, imported: DataFrame, factor: float = 0.15) -> DataFrame:
    """country, risk_score, imported_risk, amplification and adjusted_risk = clip(risk + factor * amplification)."""
    j = nodes.select("country", "risk_score").join(imported.select("country", F.col("n_risk_score").alias("imported_risk")), "country", "left")
    j = j.withColumn("amplification", r6(F.coalesce(F.col("imported_risk") - F.col("risk_score"), F.lit(0.0))))
    return j.withColumn("adjusted_risk", r6(F.least(F.greatest(F.col("risk_score") + factor * F.col("amplification"), F.lit(0.0)), F.lit(1.0))))


def top_influencers(edges: DataFrame, country: str, n: int = 10) -> DataFrame:
    """Neighbours of one country by weight, whichever end of an edge it is."""
    a = edges.filter(F.col("country_a") == country).select(F.col("country_b").alias("neighbor"), "weight")
    b = edges.filter(F.col("country_b") == country).select(F.col("country_a").alias("neighbor"), "weight")
    return a.union(b).distinct().orderBy(F.desc("weight"), "neighbor").limit(n)


def ego_network(edges: DataFrame, risk: DataFrame, country: str, default: float = 0.3) -> DataFrame:
    n = top_influencers(edges, country, 1_000_000)
    return n.join(risk.select(F.col("country").alias("neighbor"), "risk_score"), "neighbor", "left").select("neighbor", "weight", F.coalesce("risk_score", F.lit(default)).alias("risk_score"))


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, isolated nodes, mean and largest degree."""
    ends = edges.select(F.col("country_a").alias("country")).union(edges.select("country_b"))
    degree = nodes.select("country").distinct().join(ends.groupBy("country").agg(F.count("*").alias("degree")), "country", "left").fillna(0, ["degree"])
    s = degree.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"), r6(F.avg("degree")).alias("mean_degree"), F.max("degree").alias("max_degree"))
    return s.withColumn("density", r6(F.coalesce(F.try_divide(2.0 * F.col("edges"), (F.col("nodes") * (F.col("nodes") - 1)).cast("double")), F.lit(0.0))))


def network_kpis(edges: DataFrame, adjusted: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` countries with the strongest amplification, with the network's counts and mean amplification."""
    top = adjusted.orderBy(F.desc("amplification"), "country").limit(n).select("country", "amplification")
    return top.withColumns({
        "n_nodes": adjusted.agg(F.count("*")).scalar(), "mean_amplification": adjusted.agg(r6(F.avg("amplification"))).scalar(), "n_edges": edges.agg(F.count("*")).scalar(),
    })
