"""One function per read endpoint: tables in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6, risk_tier
from tidewatch.operators.clean import anchored_range
from tidewatch.operators.features import list_countries
from tidewatch.operators.network import top_influencers
from tidewatch.operators.text import corpus_stats
from tidewatch.sources.readers import country_names
from tidewatch.sources.sinks import ledger_status


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The newest row of each key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), by).alias("r")).select(key, "r.*")


def heatmap(risk: DataFrame, predictions: DataFrame) -> DataFrame:
    """Latest risk of each country with the trend of its latest prediction and a tier; unscored countries are UNKNOWN."""
    p = latest(predictions.select("country", "created", "trend"), "country", "created").select("country", "trend")
    r = latest(risk.select("country", "feature_date", "risk_score"), "country", "feature_date")
    return r.join(p, "country", "left").select("country", "feature_date", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("trend", F.lit("stable")).alias("trend"), risk_tier(F.col("risk_score"), True).alias("tier"))


def node_features(features: DataFrame, predictions: DataFrame, columns: list[str]) -> DataFrame:
    """Latest feature row with the latest prediction's heads: 0 where a feature is missing, .5 for confidence."""
    f = latest(features.select("country", "feature_date", *columns), "country", "feature_date")
    p = latest(predictions, "country", "created").drop("created", "trend")
    heads = [c for c in p.columns if c != "country"]
    j = f.join(p, "country", "left")
    return j.select("country", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns], *[F.coalesce(c, F.lit(0.5 if c == "confidence" else 0.0)).alias(c) for c in heads])


def node_features_at(risk: DataFrame, date: str, columns: list[str], heads: list[str]) -> DataFrame:
    """Nodes on a past day: the risk stands in for every head, confidence is .5."""
    return risk.filter(F.col("feature_date") == F.lit(date).cast("date")).select("country", *columns, *[F.col("risk_score").alias(f"node_{h}") for h in heads], F.lit(0.5).alias("confidence"))


def alerts(forecasts: DataFrame, risk: DataFrame, threshold: float, min_delta: float, limit: int = 50) -> DataFrame:
    """Newest forecasts over a threshold that rise against the latest risk."""
    newest = forecasts.agg(F.max("forecast_date")).scalar()
    r = latest(risk.select("country", "feature_date", "risk_score"), "country", "feature_date").select("country", F.col("risk_score").alias("current"))
    f = forecasts.filter(F.col("forecast_date") == newest).join(r, "country", "left").withColumn("current", F.coalesce("current", F.lit(0.0)))
    f = f.withColumn("delta", r6(F.col("risk_score") - F.col("current"))).filter((F.col("risk_score") >= threshold) & (F.col("delta") >= min_delta))
    return f.select("country", "horizon_step", "risk_score", "current", "delta", risk_tier(F.col("risk_score")).alias("tier")).orderBy(F.desc("delta"), "country", "horizon_step").limit(limit)


def network_nodes(enriched: DataFrame, risk: DataFrame) -> DataFrame:
    newest = enriched.agg(F.max("computed_date")).scalar()
    r = latest(risk.select("country", "feature_date", "risk_score"), "country", "feature_date").select("country", "risk_score")
    return enriched.filter(F.col("computed_date") == newest).join(r, "country").select("country", "amplification", "risk_score", risk_tier(F.col("risk_score")).alias("tier"))


def network_edges(edges: DataFrame, names: DataFrame, min_weight: float) -> DataFrame:
    """Edges of the newest date at or over a weight, with names."""
    newest = edges.agg(F.max("computed_date")).scalar()
    n = lambda k: names.select(F.col("code").alias(f"country_{k}"), F.col("name").alias(f"name_{k}"))
    e = edges.filter((F.col("computed_date") == newest) & (F.col("weight") >= min_weight))
    return e.join(n("a"), "country_a", "left").join(n("b"), "country_b", "left").select("country_a", "country_b", "weight", F.coalesce("name_a", "country_a").alias("name_a"), F.coalesce("name_b", "country_b").alias("name_b"))


def extended_score(scores: DataFrame, attributions: DataFrame, neighbors: DataFrame, top: int = 3) -> DataFrame:
    """A score with its strongest attributions and neighbours, both optional."""
    a = attributions.filter(F.col("rank") <= top).groupBy("country").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("a"))
    n = neighbors.filter(F.col("rank") <= top).groupBy("country").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor"))).alias("n"))
    join = lambda c, f: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x[f]), ",")
    j = scores.join(a, "country", "left").join(n, "country", "left")
    return j.select("country", "risk_score", join("a", "feature").alias("top_features"), join("n", "neighbor").alias("top_neighbors"))


def presentation(risk: DataFrame, names: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Names, rounded risk (null is 0) and the change to the forecast at the first and last step."""
    step = lambda s, n: F.max(F.when(F.col("horizon_step") == s, F.col("risk_score"))).alias(n)
    f = forecasts.groupBy("country").agg(step(1, "f1"), step(4, "f4"))
    j = risk.join(names.select(F.col("code").alias("country"), "name"), "country", "left").join(f, "country", "left")
    return j.select("country", F.coalesce("name", "country").alias("name"), F.round(F.coalesce("risk_score", F.lit(0.0)) + 1e-9, 3).alias("risk"), r6(F.col("f1") - F.col("risk_score")).alias("change_14"), r6(F.col("f4") - F.col("risk_score")).alias("change_56"))


def prediction_history(predictions: DataFrame, country: str, n: int) -> DataFrame:
    return predictions.filter(F.col("country") == country).orderBy(F.desc("created")).limit(n)


def latest_attributions(attributions: DataFrame) -> DataFrame:
    """All features of each country's newest computation."""
    newest = attributions.groupBy("country").agg(F.max("computed_at").alias("computed_at"))
    return attributions.join(newest, ["country", "computed_at"], "left_semi")


def top_rows(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(by), key).limit(n)


def advisory_comparison(rules: DataFrame, augmented: DataFrame) -> DataFrame:
    """The rule text beside the augmented one."""
    return rules.select("country", F.col("advisory_text").alias("rule_text")).join(augmented.select("country", F.col("advisory_text").alias("augmented_text")), "country")


def _one(rows: DataFrame, country: str) -> DataFrame:
    return rows.filter(F.col("country") == country)


def countries(features: DataFrame, names: DataFrame) -> DataFrame:
    """Every country with its newest day, its number of days and its name (the code itself where there is none)."""
    return country_names(list_countries(features).withColumnRenamed("country", "code"), names).withColumnRenamed("code", "country").select("country", "name", "last_date", "days")


def timeline(risk: DataFrame, country: str, days: int = 90) -> DataFrame:
    """A country's daily scores over the ``days`` before its newest day."""
    return anchored_range(_one(risk, country), "country", "feature_date", days)


def country_events(clusters: DataFrame, country: str, days: int = 30) -> DataFrame:
    """A country's event clusters over the ``days`` before its newest one."""
    return anchored_range(_one(clusters, country), "country", "cluster_date", days)


def country_labels(labels: DataFrame, country: str, days: int = 90) -> DataFrame:
    """A country's labels over the ``days`` before its newest one."""
    return anchored_range(_one(labels, country), "country", "label_date", days)


def browse_clusters(clusters: DataFrame, categories: list[str] | None = None, min_mentions: int = 0, country: str | None = None, days: int | None = None) -> DataFrame:
    """Clusters of some categories with at least so many mentions; of one country and its last ``days``, where given."""
    found = clusters if country is None else _one(clusters, country)
    found = anchored_range(found, "country", "cluster_date", days) if days is not None else found
    found = found.filter(F.col("category").isin(*categories)) if categories else found
    return found.filter(F.col("total_mentions") >= min_mentions)


def features_with_labels(features: DataFrame, labels: DataFrame, columns: list[str], tasks: list[str]) -> DataFrame:
    """Feature rows with the labels of their country and day, 0 where there is none."""
    l = labels.select("country", F.col("label_date").alias("feature_date"), *tasks)
    return features.select("country", "feature_date", *columns).join(l, ["country", "feature_date"], "left").fillna(0.0, tasks)


def country_spillover(edges: DataFrame, country: str, n: int = 5) -> DataFrame:
    """The heaviest edges of a country, with the neighbour at the other end."""
    own = edges.filter((F.col("country_a") == country) | (F.col("country_b") == country))
    other = F.when(F.col("country_a") == country, F.col("country_b")).otherwise(F.col("country_a"))
    return own.select(other.alias("neighbor"), "correlation", "cooccurrence", "is_adjacent", "weight").orderBy(F.desc("weight"), "neighbor").limit(n)


def country_influence(adjusted: DataFrame, edges: DataFrame, country: str, n: int = 5) -> DataFrame:
    """A country's imported risk, amplification and adjusted risk, with its ``n`` strongest neighbours, comma-joined."""
    top = top_influencers(edges, country, n).agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "neighbor"))).alias("t"))
    names = F.array_join(F.transform("t", lambda x: x["neighbor"]), ",")
    return _one(adjusted, country).select("country", "imported_risk", "amplification", "adjusted_risk", top.select(names).scalar().alias("influencers"))


def country_forecast(forecasts: DataFrame, country: str) -> DataFrame:
    """A country's forecast by step."""
    return _one(forecasts, country).orderBy("horizon_step")


def country_advisory(augmented: DataFrame, scores: DataFrame, names: DataFrame, country: str) -> DataFrame:
    """A country's name, level, confidence and advisory text with analogues."""
    a = _one(augmented, country).join(_one(scores, country).select("country", "confidence"), "country").withColumnRenamed("country", "code")
    return country_names(a, names).select(F.col("code").alias("country"), "name", "level", "confidence", "advisory_text")


def corpus_entries(corpus: DataFrame, level: str | None = None, limit: int = 20) -> DataFrame:
    """Entries of a level (of all, if none is given), by text."""
    found = corpus if level is None else corpus.filter(F.col("risk_level") == level.upper())
    return found.orderBy("text").limit(limit)


def corpus_levels(corpus: DataFrame) -> DataFrame:
    return corpus_stats(corpus)


def ingestion_runs(audit: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs of the audit log."""
    return audit.orderBy(F.desc("run_date"), "run_id").limit(limit)


def ledger_summary(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Files and events by status, with the number of all events beside them."""
    return ledger_status(ledger).withColumn("events_total", events.agg(F.count("*")).scalar())
