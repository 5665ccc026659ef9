"""Retrieval by cosine from an impact-ordered index, opening only what the bounds leave.

The index is written once: a forward table (a vector of term weights for each document), postings ordered by term and
falling weight, and for each term and band of weights (bands are factors of ``BASE``, so their number is bounded) the
count and the greatest weight. A search of many queries at once then runs in four joins:

1. The first bands of each query's terms, ``FIRST`` postings or a little more, are opened and their documents scored
   exactly. The k-th best score of a query is its bar.
2. Each (query, term) starts with its greatest contribution as the bound of what is unopened. Bands are opened by the bound
   they take away for each posting, most first, until the bounds of a query together stay below ``SLACK`` of its bar.
3. A document met in opened bands has its contributions there and the bounds of its other terms; if these stay below the bar,
   it is not scored. A document met nowhere can't reach the bar.
4. The documents left are scored exactly by their vectors.

Ranks are those of scoring every pair: similarities are rounded to ``DIGITS`` places before they are ranked, so the bar is
taken lower by one unit of the last place.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6
from tidewatch.operators.text import occurrences, vocabulary_counts
from tidewatch.sources.scratch import counted_broadcast, materialize, new_path

BASE = 1.2
FIRST = 16
SLACK = 0.7
DIGITS = 4


class Index(NamedTuple):
    #: doc, vector (term to weight)
    forward: DataFrame
    #: term, band, weight, doc
    postings: DataFrame
    #: term, band, n, top
    bands: DataFrame
    key: str


def write_index(docs: DataFrame, key: str, path: str, text: str = "text", size: int = 800) -> Index:
    """Index the documents' terms among the ``size`` most frequent: term share times ln((1+N)/(1+df))+1, L2-normalised."""
    spark = docs.sparkSession
    counts, idf = vocabulary_counts(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc", size=size)
    part = F.col("n") * F.col("idf")
    rows = counts.join(counted_broadcast(idf), "term").groupBy("doc").agg(F.collect_list(F.struct("term", part.alias("w"))).alias("r"), F.sum("n").alias("total"), F.sqrt(F.sum(part * part)).alias("norm"))
    weight = lambda w: w / F.col("total") / (F.col("norm") / F.col("total") + 1e-8)
    vector = F.map_from_entries(F.transform("r", lambda x: F.struct(x["term"], weight(x["w"]))))
    rows.select("doc", vector.alias("vector")).write.parquet(f"{path}/forward")
    each = spark.read.parquet(f"{path}/forward").select(F.explode("vector").alias("term", "weight"), "doc")
    band = F.greatest(F.floor(-F.log("weight") / F.log(F.lit(BASE))), F.lit(0)).cast("int")
    each = each.select("term", band.alias("band"), "weight", "doc").repartitionByRange("term", "band", F.col("weight").desc()).sortWithinPartitions("term", "band", F.desc("weight"))
    each.write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term", "band").agg(F.count("*").alias("n"), F.max("weight").alias("top")).write.parquet(f"{path}/bands")
    return read_index(spark, path, key)


def read_index(spark: SparkSession, path: str, key: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("forward", "postings", "bands")), key)


def query_vectors(index: Index, queries: DataFrame, query_key: str, text: str = "text") -> DataFrame:
    """query, term, q: counts over the index's vocabulary, L2-normalised."""
    found = occurrences(queries, query_key, text, "query").groupBy("query", "term").agg(F.count("*").alias("n"))
    q = found.join(index.bands.select("term").distinct(), "term", "left_semi")
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("query"))) + 1e-8
    return q.select("query", "term", (F.col("n") / norm).alias("q"))


def _scored(index: Index, pairs: DataFrame, q: DataFrame) -> DataFrame:
    """query, doc, score of each of ``pairs`` by the documents' vectors."""
    asked = q.groupBy("query").agg(F.collect_list(F.struct("term", "q")).alias("__asked"))
    both = index.forward.join(pairs, "doc").join(asked, "query")
    score = F.aggregate("__asked", F.lit(0.0), lambda s, x: s + x["q"] * F.coalesce(F.try_element_at("vector", x["term"]), F.lit(0.0)))
    return both.select("query", "doc", score.alias("score"))


def bars(index: Index, q: DataFrame, steps: DataFrame, k: int, min_sim: float, first: int = FIRST) -> DataFrame:
    """query, bar: the k-th best score among the documents of each query's first bands, at least ``min_sim``."""
    opened = counted_broadcast(steps.filter(F.col("before") < first).select("query", "term", "band"))
    pairs = index.postings.join(opened, ["term", "band"]).select("query", "doc").repartition("query", "doc").distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    kth = _scored(index, pairs, q).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    low = F.greatest(F.when(F.col("n") >= k, F.col("s")), F.lit(min_sim))
    return kth.select("query", (low - 10.0**-DIGITS).alias("bar"))


def candidates(index: Index, q: DataFrame, k: int, min_sim: float) -> tuple[DataFrame, DataFrame]:
    """(query, term, band) of the bands to open, and (query, doc) of the documents that may reach the bar."""
    along = Window.partitionBy("query", "term").orderBy("band")
    s = q.join(counted_broadcast(index.bands), "term")
    s = s.withColumn("next", F.coalesce(F.lead("top").over(along), F.lit(0.0))).withColumn("before", F.sum("n").over(along) - F.col("n"))
    s = s.withColumn("drop", F.col("q") * (F.col("top") - F.col("next"))).withColumn("rate", F.min(F.col("drop") / F.col("n")).over(along))
    steps = materialize(s.select("query", "term", "band", "q", "n", "top", "next", "before", "drop", "rate"))
    bar = bars(index, q, steps, k, min_sim)
    whole = F.sum(F.when(F.col("before") == 0, F.col("q") * F.col("top"))).over(Window.partitionBy("query"))
    order, own = Window.partitionBy("query").orderBy(F.desc("rate"), "term", "band"), Window.partitionBy("query", "term")
    o = steps.withColumn("rest", whole - F.sum("drop").over(order) + F.col("drop")).join(bar, "query")
    o = o.withColumn("open", F.col("rest") >= SLACK * F.col("bar"))
    o = o.withColumn("left", F.col("q") * F.coalesce(F.min(F.when(F.col("open"), F.col("next"))).over(own), F.max("top").over(own)))
    # what is unopened of all terms of the query
    bound = F.sum(F.when(F.col("before") == 0, F.col("left"))).over(Window.partitionBy("query"))
    opened = materialize(o.withColumn("bound", bound).filter("open").select("query", "term", "band", "q", "left", (F.col("bar") - F.col("bound")).alias("least")))
    # postings come by term, so a task would hold nearly all its pairs before it shuffled them: they are dealt out as they are
    gains = index.postings.join(counted_broadcast(opened), ["term", "band"]).select("query", "doc", (F.col("q") * F.col("weight") - F.col("left")).alias("gain"), "least")
    met = gains.repartition("query", "doc").groupBy("query", "doc").agg(F.sum("gain").alias("gain"), F.first("least").alias("least"))
    return opened, met.filter(F.col("gain") >= F.col("least") - 1e-9).select("query", "doc")


def search(index: Index, queries: DataFrame, query_key: str, text: str = "text", k: int = 3, min_sim: float = 0.05) -> DataFrame:
    """query_key, rank, key, similarity: the ``k`` documents of highest cosine with plain query counts, ``min_sim`` at least."""
    q = materialize(query_vectors(index, queries, query_key, text))
    _, pairs = candidates(index, q, k, min_sim)
    found = _scored(index, pairs, q).select("query", "doc", r6(F.col("score"), DIGITS).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "doc")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("similarity") >= min_sim))
    return ranked.select(F.col("query").alias(query_key), "rank", F.col("doc").alias(index.key), "similarity")


def retrieve(docs: DataFrame, queries: DataFrame, key: str, query_key: str, **options) -> DataFrame:
    """``search`` in an index of ``docs`` that is written to the shared folder."""
    return search(write_index(docs, key, new_path(docs.sparkSession)), queries, query_key, **options)
