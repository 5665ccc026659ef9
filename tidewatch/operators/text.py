"""Retrieval over a text corpus, rule advisories and vector neighbours, in long (document, term) form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6, risk_tier
from tidewatch.sources.scratch import counted_broadcast, materialize

# The stop list.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "in", "of", "to", "and",
    "or", "for", "on", "at", "by", "have", "has", "been", "be",
    "with", "from", "this", "that", "it", "its", "were", "was",
    "as", "not", "but", "all", "also", "their",
)


def tokens(text: Column, stop=STOP_WORDS) -> Column:
    """Lower-case words of two or more ASCII letters that are no stop words; repeats kept."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    stops = F.array(*map(F.lit, stop))
    return F.filter(words, lambda w: w.rlike("^[a-z]{2,}$") & ~F.array_contains(stops, w))


#: A word of two or more ASCII letters that touches no other letter, digit or underscore.
WORD = r"(?<![\p{L}\p{N}_])[a-z]{2,}+(?![\p{L}\p{N}_])"


def occurrences(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``key`` as ``name`` and term, one row per occurrence; the same terms as ``tokens``."""
    words = rows.select(F.col(key).alias(name), F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("term"))
    return words.filter(~F.col("term").isin(*STOP_WORDS))


def terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, n."""
    return occurrences(docs, key, text, key).groupBy(key, "term").agg(F.count("*").alias("n"))


def build_vocabulary(found: DataFrame, size: int = 800) -> DataFrame:
    """The most frequent terms of ``found``, one row per occurrence; ties by term."""
    return found.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(size)


def vocabulary_counts(docs: DataFrame, key: str, text: str = "text", size: int = 800) -> tuple[DataFrame, DataFrame]:
    """key, term, n of the ``size`` most frequent terms, and their idf, ln((1+N)/(1+df))+1, as term and idf; both written once."""
    found = occurrences(docs, key, text, key)
    # texts are gone through twice, so that words outside the vocabulary are never shuffled by row
    vocabulary = materialize(build_vocabulary(found, size).select("term"))
    counts = materialize(found.join(counted_broadcast(vocabulary), "term").groupBy(key, "term").agg(F.count("*").alias("n")))
    n = docs.agg(F.count("*")).scalar()
    return counts, materialize(counts.groupBy("term").agg((F.log((1 + n) / (1 + F.count("*"))) + 1.0).alias("idf")))


def tfidf_index(docs: DataFrame, key: str, text: str = "text", size: int = 800) -> DataFrame:
    """key, term, weight: term share of the row's vocabulary terms, times ln((1+N)/(1+df))+1, L2-normalised."""
    counts, idf = vocabulary_counts(docs, key, text, size)
    part = F.col("n") * F.col("idf")
    rows = counts.join(counted_broadcast(idf), "term").groupBy(key).agg(F.collect_list(F.struct("term", part.alias("w"))).alias("r"), F.sum("n").alias("total"), F.sqrt(F.sum(part * part)).alias("norm"))
    each = rows.select(key, "total", "norm", F.explode("r").alias("r"))
    return each.select(key, "r.term", (F.col("r.w") / F.col("total") / (F.col("norm") / F.col("total") + 1e-8)).alias("weight"))


def retrieve(index: DataFrame, queries: DataFrame, key: str, query_key: str, text: str = "text", k: int = 3, min_sim: float = 0.05) -> DataFrame:
    """query_key, rank, key, similarity: cosine with plain query counts over the vocabulary; an inverted-index join on the term."""
    q = terms(queries, query_key, text).join(index.select("term").distinct(), "term", "left_semi")
    norm = q.groupBy(query_key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    q = q.join(norm, query_key).select(query_key, "term", (F.col("n") / (F.col("norm") + 1e-8)).alias("__q"))
    s = q.join(index, "term").groupBy(query_key, key).agg(r6(F.sum(F.col("__q") * F.col("weight")), 4).alias("similarity"))
    w = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return s.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("similarity") >= min_sim)).select(query_key, "rank", key, "similarity")


# Wordings of generated situations.
SITUATIONS = {
    "protest": "significant protest activity", "military": "military and armed conflict events", "terrorism": "terrorism and asymmetric violence",
    "sanctions": "sanctions and economic coercion measures", "diplomatic": "diplomatic tensions and negotiations",
}


def corpus_from_clusters(clusters: DataFrame, limit: int = 500, since: str | None = None) -> DataFrame:
    """Situations described by the clusters with most mentions: situation_type, risk_level, text, tags."""
    c = clusters.filter(F.col("cluster_date") >= F.lit(since).cast("date")) if since else clusters
    c = c.orderBy(F.desc("total_mentions"), "country", "cluster_date", "category").limit(limit).filter("event_count >= 3 and total_mentions >= 10")
    g, m, t = F.coalesce("avg_goldstein", F.lit(0.0)), F.col("total_mentions"), F.coalesce("avg_tone", F.lit(0.0))
    level = F.when((g < -6) | (m > 5000), "CRITICAL").when((g < -4) | (m > 2000), "HIGH").when((g < -2) | (m > 500), "ELEVATED").when(g < 0, "MODERATE").otherwise("LOW")
    what = F.coalesce(F.create_map(*[F.lit(x) for kv in SITUATIONS.items() for x in kv])[F.col("category")], F.col("category"))
    gold = F.when(g < -5, "with extreme negative Goldstein scale scores indicating severe destabilisation").when(g < -3, "with strongly negative conflict indicators").when(g < 0, "with moderately negative conflict indicators").otherwise("")
    tone = F.when(t < -10, "Media coverage is strongly hostile").when(t < -5, "Media tone is negative").otherwise("")
    text = F.concat(F.lit("Recorded "), what, F.lit(" ("), F.col("event_count").cast("string"), F.lit(" events, "), m.cast("string"), F.lit(" mentions) "), gold, F.lit(". "), tone, F.lit(". Average Goldstein scale: "), F.format_string("%.1f", g), F.lit("."))
    return c.withColumn("risk_level", level).select(
        "country", "cluster_date", "category", F.concat_ws("_", "category", F.lower("risk_level"), F.lit("auto")).alias("situation_type"), "risk_level", text.alias("text"),
        F.array("category", "country", F.lower("risk_level")).alias("tags"))


def corpus_text(corpus: DataFrame) -> DataFrame:
    """``corpus`` with ``indexed``: text, tags, situation type without underscores and level in one string."""
    return corpus.withColumn("indexed", F.concat_ws(" ", "text", F.array_join("tags", " "), F.translate("situation_type", "_", " "), "risk_level"))


def rebuild_corpus(seed: DataFrame, stored: DataFrame, newest: int = 500) -> DataFrame:
    """The seed entries and the newest stored ones."""
    cols = ["situation_type", "risk_level", "text", "tags"]
    return seed.select(*cols).unionByName(stored.orderBy(F.desc("created"), "text").limit(newest).select(*cols))


def browse_corpus(corpus: DataFrame, level: str, limit: int) -> DataFrame:
    return corpus.filter(F.col("risk_level") == level).orderBy("text").limit(limit)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("risk_level").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "risk_level")


# Wordings of advisories by level, trend and head, with their thresholds in order.
LEVEL_TEXTS = {
    "CRITICAL": ("CRITICAL RISK — ", " presents maximum instability indicators over the monitoring period. Significant deterioration is assessed with high confidence. Immediate elevated monitoring warranted."),
    "HIGH": ("HIGH RISK — ", " shows strong escalation indicators across multiple dimensions. Conditions may deteriorate further within the 30-day forecast horizon."),
    "ELEVATED": ("ELEVATED RISK — ", " exhibits above-threshold instability signals. Monitor closely for further deterioration."),
    "MODERATE": ("MODERATE RISK — ", " shows some instability indicators but remains below high-risk thresholds. Routine monitoring recommended."),
    "LOW": ("LOW RISK — ", " currently presents minimal instability indicators. Continue standard monitoring cadence."),
}
TREND_TEXTS = {"increasing": "Risk trajectory is increasing — conditions may worsen within the 30-day forecast window.", "decreasing": "Risk trajectory is improving — monitor for consolidation."}
HEAD_TEXTS = (
    ("war", 0.70, "Elevated military escalation risk detected. Cross-border incidents or mobilization events observed."),
    ("terrorism", 0.65, "Elevated terrorism and asymmetric conflict indicators."),
    ("instability", 0.75, "High internal political instability. Civil unrest or governance disruption likely."),
    ("financial", 0.60, "Economic stress indicators elevated. Sanctions, capital flight, or fiscal strain detected."),
    ("war", 0.50, "Low-level military activity noted."),
    ("terrorism", 0.45, "Security incidents trending above baseline."),
)
HEAD_DRIVERS = {"instability": "Political instability", "war": "Military / armed conflict risk", "terrorism": "Terrorism / asymmetric threat", "financial": "Economic / financial stress"}
FEATURE_DRIVERS = {
    "protest_score": (0.30, "Civil protests and demonstrations"), "violence_score": (0.30, "Material conflict events"), "diplomatic_stress": (0.40, "Diplomatic tensions"),
    "economic_stress": (0.30, "Economic sanctions or shocks"), "terrorism_score": (0.25, "Terrorism-related incidents"),
}
NO_DRIVER = "General instability indicators"


def rule_advisory(scores: DataFrame) -> DataFrame:
    """scores: country, risk_score, trend and the four heads. country, level, advisory_text, short_summary."""
    level, parts = risk_tier(F.col("risk_score")), []
    head = F.lit(None).cast("string")
    for name, (before, after) in LEVEL_TEXTS.items():
        head = F.when(level == name, F.concat(F.lit(before), F.col("country"), F.lit(after))).otherwise(head)
    parts.append(head)
    parts.append(F.when(F.col("trend") == "increasing", TREND_TEXTS["increasing"]).when(F.col("trend") == "decreasing", TREND_TEXTS["decreasing"]))
    done: dict[str, Column] = {}
    for name, bound, said in HEAD_TEXTS:
        hit = F.col(name) >= bound
        parts.append(F.when(hit & ~done[name] if name in done else hit, said))
        done[name] = done[name] | hit if name in done else hit
    arrow = F.when(F.col("trend") == "increasing", "↑").when(F.col("trend") == "decreasing", "↓").when(F.col("trend") == "stable", "→").otherwise("")
    return scores.select("country", level.alias("level"), F.concat_ws(" ", *parts).alias("advisory_text"), F.concat("country", F.lit(": "), level, F.lit(" ("), F.format_string("%.2f", "risk_score"), F.lit(") "), arrow).alias("short_summary"))


def major_drivers(scores: DataFrame, n: int = 3, head_bound: float = 0.40) -> DataFrame:
    """country and drivers: labels of heads and features over their bounds, by score and label descending, distinct."""
    cand = [(F.col(h), head_bound, label) for h, label in HEAD_DRIVERS.items()] + [(F.col(f), b, label) for f, (b, label) in FEATURE_DRIVERS.items() if f in scores.columns]
    found = F.array_compact(F.array(*[F.when(s >= b, F.struct(s.cast("double").alias("s"), F.lit(label).alias("l"))) for s, b, label in cand]))
    labels = F.slice(F.array_distinct(F.transform(F.sort_array(found, asc=False), lambda x: x["l"])), 1, n)
    return scores.select("country", F.when(F.size(found) == 0, F.array(F.lit(NO_DRIVER))).otherwise(labels).alias("drivers"))


def retrieval_query(scores: DataFrame, trajectories: DataFrame) -> DataFrame:
    """country and query text from level, trend, drivers and the direction of the forecast (array ``trajectory``)."""
    s = scores.join(major_drivers(scores), "country").join(trajectories, "country", "left")
    first, last = F.get("trajectory", F.lit(0)), F.element_at("trajectory", -1)
    way = F.when(F.size("trajectory") >= 2, F.when(last > first + 0.05, "deteriorating trajectory escalation").when(last < first - 0.05, "improving trajectory de-escalation"))
    words = F.when(F.col("risk_score") >= 0.8, "critical instability conflict crisis").when(F.col("risk_score") >= 0.65, "high risk armed conflict protests")
    return s.select("country", F.concat_ws(" ", risk_tier(F.col("risk_score")), "trend", F.array_join("drivers", " "), way, words).alias("query"))


def augment_advisory(advisories: DataFrame, analogues: DataFrame, trajectories: DataFrame, most: int = 2) -> DataFrame:
    """Advisory texts with up to ``most`` analogues (country, rank, risk_level, situation_type, text) and a forecast sentence."""
    said = F.concat(F.lit("["), "risk_level", F.lit("/"), F.translate("situation_type", "_", " "), F.lit("] "), "text")
    a = analogues.filter(F.col("rank") <= most).groupBy("country").agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("said")))).alias("a"))
    j = advisories.join(a, "country", "left").join(trajectories, "country", "left")
    first, last = F.get("trajectory", F.lit(0)), F.element_at("trajectory", -1)
    weeks = (F.size("trajectory") * 2).cast("string")
    text = lambda before, after: F.concat(F.lit(before), F.format_string("%.2f", last), F.lit(after), weeks, F.lit(" weeks"))
    clause = F.when(last > first + 0.08, F.concat(text("Model forecast projects risk escalating to ", " within "), F.lit(" — heightened monitoring advised."))).when(
        last < first - 0.08, F.concat(text("Model forecast projects risk moderating to ", " within "), F.lit(" — conditions may stabilise."))).otherwise(
        F.concat(F.lit("Model forecast is stable ("), F.format_string("%.2f", last), F.lit(") over the next "), weeks, F.lit(" weeks.")))
    analog = F.when(F.size("a") > 0, F.concat(F.lit("Historical analogues of similar risk patterns: "), F.array_join(F.transform("a", lambda x: x["said"]), " — ")))
    return j.select("country", "level", F.concat_ws(" ", "advisory_text", analog, F.when(F.size("trajectory") > 0, clause)).alias("advisory_text"))


def trajectories(forecasts: DataFrame) -> DataFrame:
    """country and trajectory: its forecast risk by step."""
    g = forecasts.groupBy("country").agg(F.sort_array(F.collect_list(F.struct("horizon_step", "risk_score"))).alias("t"))
    return g.select("country", F.transform("t", lambda x: x["risk_score"]).alias("trajectory"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 64) -> DataFrame:
    """query_id, rank, vec_id, cosine: nearest by cosine among all other vectors.

    Queries are dealt into blocks of about ``block``, and every vector meets each block by an equi-join on its number;
    Spark keeps k rows per query and task before it shuffles them.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    n = queries.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int")).scalar()
    blocks = queries.select(F.pmod(F.xxhash64("vec_id"), n).cast("int").alias("b"), F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("e")).alias("q")).groupBy("b").agg(F.collect_list("q").alias("qs"))
    v = vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), n - 1)).alias("b")).join(blocks, "b")
    v = v.select("vec_id", "embedding", F.explode("qs").alias("q")).filter("q.id <> vec_id")
    c = r6(dot("embedding", "q.e") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("q.e", "q.e"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return v.select(F.col("q.id").alias("query_id"), "vec_id", c.alias("cosine")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
