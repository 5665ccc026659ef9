"""Daily features, clusters, weekly and per-country aggregates, rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import n_if, r6, share
from tidewatch.operators.order_stats import percentiles
from tidewatch.operators.clean import classified

SCORES = ("protest_score", "violence_score", "diplomatic_stress", "economic_stress", "terrorism_score", "avg_sentiment", "avg_goldstein")
VIOLENT = (18, 19, 20)
ECONOMIC = (15, 16, 163)


def daily_features(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ten measures per (country, day). Averages skip nulls; shares are of all rows."""
    root, quad = F.col("event_root_code"), F.col("quad_class")
    e = events.filter(F.coalesce("action_geo_country", F.lit("")) != "")
    e = e.filter(F.col("event_date") >= F.lit(start).cast("date")) if start else e
    e = e.filter(F.col("event_date") <= F.lit(end).cast("date")) if end else e
    gold = (F.coalesce(F.avg("goldstein"), F.lit(0.0)) + 10.0) / 20.0
    tone = (F.coalesce(F.avg("avg_tone"), F.lit(0.0)) + 100.0) / 200.0
    return e.groupBy(F.col("action_geo_country").alias("country"), F.col("event_date").alias("feature_date")).agg(
        F.count("*").alias("total_events"),
        n_if(quad.isin(3, 4)).alias("conflict_events"),
        n_if(quad.isin(1, 2)).alias("cooperation_events"),
        r6(share(root == 14)).alias("protest_score"),
        r6(share((F.coalesce(quad, F.lit(0)) == 4) | F.coalesce(root, F.lit(0)).isin(*VIOLENT))).alias("violence_score"),
        r6(1.0 - gold).alias("diplomatic_stress"),
        r6(share(root.isin(*ECONOMIC))).alias("economic_stress"),
        r6(share(root.isin(*VIOLENT) & (quad == 4))).alias("terrorism_score"),
        r6(F.least(F.greatest(tone, F.lit(0.0)), F.lit(1.0))).alias("avg_sentiment"),
        r6(gold).alias("avg_goldstein"),
    )


def rows_per_date(features: DataFrame) -> DataFrame:
    return features.groupBy("feature_date").agg(F.count("*").alias("n"))


POLECAT_VIOLENT = ("ASSAULT", "MOBILIZE", "RETREAT")


def polecat_daily_features(rows: DataFrame) -> DataFrame:
    """The same shape from typed events: country, event_date, event_type, quad_code, event_intensity."""
    kind, quad = F.upper(F.trim("event_type")), F.upper(F.trim("quad_code"))
    gold = F.round((F.coalesce(F.avg("event_intensity"), F.lit(0.0)) + 10.0) / 20.0 + 1e-9, 6)
    conflict = F.coalesce(F.contains(quad, F.lit("CONFLICT")), F.lit(False))
    out = rows.groupBy("country", F.col("event_date").alias("feature_date")).agg(
        F.count("*").alias("total_events"),
        n_if(conflict).alias("conflict_events"),
        n_if(~conflict).alias("cooperation_events"),
        r6(share(kind == "PROTEST")).alias("protest_score"),
        r6(share(kind.isin(*POLECAT_VIOLENT))).alias("violence_score"),
        r6(share((kind == "ASSAULT") & F.contains(quad, F.lit("MATERIAL CONFLICT")))).alias("terrorism_score"),
        r6(share(kind == "SANCTION")).alias("economic_stress"),
        gold.alias("avg_goldstein"),
    )
    return out.withColumns({
        "diplomatic_stress": r6(1.0 - F.col("avg_goldstein")),
        "avg_sentiment": r6(F.col("cooperation_events") / (F.col("conflict_events") + F.col("cooperation_events"))),
    })


def weighted_daily_features(events: DataFrame, min_events: int = 5) -> DataFrame:
    """Mention-weighted shares and means per (country, day)."""
    w = F.greatest(F.coalesce("num_mentions", F.lit(1)), F.lit(1)).cast("double")
    part = lambda c: F.sum(F.when(c, w).otherwise(0.0)) / F.sum(w)
    mean = lambda c: F.sum(F.coalesce(c, F.lit(0.0)) * w) / F.sum(w)
    root_text = F.col("event_root_code").cast("string")
    gold = mean(F.col("goldstein"))
    return events.groupBy("country", "event_date").agg(
        F.count("*").alias("n_events"),
        r6(part(F.col("quad_class").isin(3, 4))).alias("protest"),
        r6(part(F.col("quad_class") == 4)).alias("violence"),
        r6(F.greatest(-gold, F.lit(0.0)) / 10.0).alias("diplo"),
        r6(part(F.substring(root_text, 1, 2).isin("16", "17"))).alias("econ"),
        r6(part(F.startswith(F.col("event_base_code").cast("string"), F.lit("18")))).alias("terror"),
        r6(F.least(F.greatest(-mean(F.col("avg_tone")), F.lit(0.0)) / 30.0, F.lit(1.0))).alias("tone_neg"),
        r6((gold + 10.0) / 20.0).alias("goldstein_norm"),
    ).filter(F.col("n_events") >= min_events)


WEIGHTED = ("protest", "violence", "diplo", "econ", "terror", "tone_neg", "goldstein_norm")


def percentile_rank_day(features: DataFrame, min_countries: int = 5) -> DataFrame:
    """Ordinal rank / N of each feature within its day, goldstein inverted first; days with few countries unchanged."""
    n = F.count("*").over(Window.partitionBy("event_date"))

    def ranked(c: str) -> Column:
        order = F.desc(c) if c == "goldstein_norm" else F.asc(c)
        return F.when(n < min_countries, F.col(c)).otherwise(r6(F.row_number().over(Window.partitionBy("event_date").orderBy(order, "country")) / n))

    return features.select("country", "event_date", *[ranked(c).alias(c) for c in WEIGHTED])


def event_clusters(events: DataFrame) -> DataFrame:
    """Per (country, day, category): counts, mentions, means and the strongest event."""
    e = classified(events).filter(F.coalesce("action_geo_country", F.lit("")) != "")
    return e.groupBy(F.col("action_geo_country").alias("country"), F.col("event_date").alias("cluster_date"), "category").agg(
        F.count("*").alias("event_count"),
        F.sum(F.coalesce("num_mentions", F.lit(0))).alias("total_mentions"),
        r6(F.avg("goldstein"), 4).alias("avg_goldstein"),
        r6(F.avg("avg_tone"), 4).alias("avg_tone"),
        r6(F.max(F.abs("goldstein")), 4).alias("max_intensity"),
    )


def top_actor_pairs(events: DataFrame, n: int = 5) -> DataFrame:
    """Per cluster the ``n`` most frequent actor pairs, as an array of (actor1, actor2, count), most frequent first."""
    name = lambda k: F.substring(F.coalesce(F.nullif(F.col(f"actor{k}_name"), F.lit("")), F.col(f"actor{k}_country")), 1, 40)
    e = classified(events).withColumns({"actor1": name(1), "actor2": name(2)}).filter("coalesce(actor1, '') <> '' and coalesce(actor2, '') <> ''")
    key = [F.col("action_geo_country").alias("country"), F.col("event_date").alias("cluster_date"), "category"]
    counts = e.groupBy(*key, "actor1", "actor2").agg(F.count("*").alias("n"))
    w = Window.partitionBy("country", "cluster_date", "category").orderBy(F.desc("n"), "actor1", "actor2")
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.groupBy("country", "cluster_date", "category").agg(F.sort_array(F.collect_list(F.struct("rank", "actor1", "actor2", "n"))).alias("pairs"))


def pairs_json(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pairs", F.to_json(F.transform("pairs", lambda p: F.struct(p["actor1"].alias("actor1"), p["actor2"].alias("actor2"), p["n"].alias("count")))))


def merged_actor_pairs(clusters: DataFrame, limit: int = 10) -> DataFrame:
    """Pairs of all clusters' JSON, summed; the ``limit`` most frequent."""
    p = clusters.select(F.explode(F.from_json("pairs", "array<struct<actor1:string,actor2:string,count:bigint>>")).alias("p"))
    return p.groupBy("p.actor1", "p.actor2").agg(F.sum("p.count").alias("n")).orderBy(F.desc("n"), "actor1", "actor2").limit(limit)


def weekly_features(features: DataFrame) -> DataFrame:
    """Monday weeks: means of the scores and the sum of events."""
    return features.groupBy("country", F.date_trunc("week", "feature_date").cast("date").alias("week")).agg(
        F.sum("total_events").alias("total_events"), *[r6(F.avg(c)).alias(c) for c in SCORES])


def global_risk_summary(risk: DataFrame) -> DataFrame:
    g = risk.groupBy("feature_date").agg(F.count("*").alias("countries"), r6(F.avg("risk_score")).alias("avg_risk"), F.max("risk_score").alias("max_risk"))
    p = percentiles(risk, ["feature_date"], "risk_score", {"p90": 0.9}).select("feature_date", r6(F.col("p90")).alias("p90_risk"))
    return g.join(p, "feature_date", "left")


def labeled_countries(labels: DataFrame, min_days: int = 30) -> DataFrame:
    return labels.groupBy("country").agg(
        F.min("label_date").alias("first_date"), F.max("label_date").alias("last_date"), F.count("*").alias("days"),
        *[r6(F.avg(f"{t}_label")).alias(f"avg_{t}") for t in ("instability", "war", "terrorism", "financial")]).filter(F.col("days") >= min_days)


def list_countries(features: DataFrame) -> DataFrame:
    return features.groupBy("country").agg(F.max("feature_date").alias("last_date"), F.count("*").alias("days"))


def category_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("country", "category").agg(F.sum("event_count").alias("events"), F.sum("total_mentions").alias("mentions"), r6(F.avg("avg_goldstein"), 4).alias("avg_goldstein"))


def explorer_kpis(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.sum("event_count").alias("events"), F.sum("total_mentions").alias("mentions"), F.count_distinct("cluster_date").alias("days"), F.count_distinct("category").alias("categories"), F.count_distinct("country").alias("countries"))


def mentions_over_time(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_date", "category").agg(F.sum("total_mentions").alias("mentions"))


def actor_registry(events: DataFrame) -> DataFrame:
    """Per actor code: its latest name, country and type, mentions and last day; both actors of each event."""
    side = lambda k: events.select(F.col(f"actor{k}_code").alias("actor_code"), F.col(f"actor{k}_name").alias("name"), F.col(f"actor{k}_country").alias("country"), F.col(f"actor{k}_type1").alias("type"), "num_mentions", "event_date", "global_event_id")
    both = side(1).unionByName(side(2)).filter("actor_code is not null")
    newest = lambda c: F.max_by(c, F.struct("event_date", "global_event_id")).alias(c)
    return both.groupBy("actor_code").agg(newest("name"), newest("country"), newest("type"), F.sum("num_mentions").alias("mentions"), F.max("event_date").alias("last_seen"))


def country_coverage(features: DataFrame, limit: int = 10) -> DataFrame:
    """Countries with most days that have any events."""
    return features.filter("total_events > 0").groupBy("country").agg(F.count("*").alias("days")).orderBy(F.desc("days"), "country").limit(limit)


def rolling_norm_stats(features: DataFrame, as_of: str, window: int = 90, min_rows: int = 3) -> DataFrame:
    """Mean and population deviation per (country, feature) over the window that ends on ``as_of``."""
    day = F.lit(as_of).cast("date")
    long = features.filter((F.col("feature_date") <= day) & (F.col("feature_date") > F.date_sub(day, window))).unpivot(["country"], list(SCORES), "feature", "value")
    sd = F.stddev_pop("value")
    return long.groupBy("country", "feature").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.when(sd <= 1e-9, 1.0).otherwise(sd)).alias("std")).filter(F.col("n") >= min_rows).withColumn("computed_date", day)


def latest_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumn("__d", F.max("computed_date").over(Window.partitionBy("country", "feature"))).filter("computed_date = __d").drop("__d")


def zscores(features: DataFrame, stats: DataFrame, clip: float = 3.0) -> DataFrame:
    """country, feature_date, feature, z and z clipped to +-``clip``."""
    long = features.unpivot(["country", "feature_date"], list(SCORES), "feature", "value")
    z = F.when(F.col("std") < 1e-9, 0.0).otherwise((F.col("value") - F.col("mean")) / F.col("std"))
    return long.join(latest_stats(stats).select("country", "feature", "mean", "std"), ["country", "feature"]).select(
        "country", "feature_date", "feature", r6(z, 4).alias("z"), r6(F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)), 4).alias("z_clipped"))


def resample_biweekly(features: DataFrame, days: int = 14) -> DataFrame:
    """Non-overlapping means anchored at each country's first day; empty bins are absent."""
    first = features.groupBy("country").agg(F.min("feature_date").alias("first"))
    b = features.join(first, "country").withColumn("bin", F.floor(F.datediff("feature_date", "first") / days).cast("int"))
    return b.groupBy("country", "bin").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in SCORES])
