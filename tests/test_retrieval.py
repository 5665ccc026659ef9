import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import retrieval, text
from tidewatch.sources.scratch import new_path

SF = "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_lose_nothing(spark, seed):
    """Equal to scoring every pair, ties by key, on texts of very different lengths."""
    rng = random.Random(seed)
    words = [a + b for a in "bcdfghjk" for b in ("ar", "el", "ix", "on")]
    make = lambda n: " ".join(rng.choice(words[: rng.choice([4, 12, 32])]) for _ in range(n))
    texts = [make(rng.choice([0, 1, 3, 10, 60])) for _ in range(300)] + [None, "", "The AND of", "bar_el é1x", "barbar,bar-el"] + ["bar bel"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = [make(rng.randint(1, 12)) for _ in range(25)] + [None, "", "zz", "bar bel"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q long, text string")
    cols = ("q", "rank", "id", "similarity")
    plain = text.tfidf_index(docs, "id", size=24).cache()
    index = retrieval.write_index(docs, "id", new_path(spark), size=24)
    for k, least in ((3, 0.05), (1, 0.5), (400, 0.0)):
        want = rows(text.retrieve(plain, queries, "id", "q", k=k, min_sim=least), *cols)
        assert rows(retrieval.search(index, queries, "q", k=k, min_sim=least), *cols) == want and want


def test_few_pairs_are_scored(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = retrieval.write_index(docs, "doc_id", new_path(spark))
    q = retrieval.query_vectors(index, items, "item_id")
    opened, pairs = retrieval.candidates(index, q, 3, 0.05)
    postings = lambda steps: index.postings.join(steps, ["term", "band"] if "band" in steps.columns else "term").count()
    assert pairs.count() < 0.1 * docs.count() * items.count()
    assert postings(opened) < 0.6 * postings(q)


def test_index_is_in_impact_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = new_path(spark)
    retrieval.write_index(docs, "doc_id", path)
    index = retrieval.read_index(spark, path, "doc_id")
    assert index.postings.groupBy("term", "band").agg(F.count("*").alias("n"), F.max("weight").alias("top")).exceptAll(index.bands.select("term", "band", "n", "top")).isEmpty()
    per_file = index.postings.groupBy(F.input_file_name().alias("f"), "term").agg(F.max("band").alias("a"), F.min("band").alias("b"))
    assert per_file.groupBy("term").count().filter("count > 2").count() == 0  # a term's postings stand together
    want = {(r.doc_id, r.term): r.weight for r in text.tfidf_index(docs, "doc_id").collect()}
    assert {(r.doc, r.term): pytest.approx(want[r.doc, r.term]) for r in index.postings.collect()} == want


def test_retrieval_of_nothing(spark):
    docs = spark.createDataFrame([(1, "alpha beta")], "id long, text string")
    q = spark.createDataFrame([(1, "alpha")], "q long, text string")
    assert retrieval.retrieve(docs.limit(0), q, "id", "q").collect() == [] and retrieval.retrieve(docs, q.limit(0), "id", "q").collect() == []
    assert retrieval.retrieve(docs, q, "id", "q").count() == 1


def test_texts_are_not_read_again_for_the_weights(spark):
    """The tf-idf index rests on counts of its vocabulary that are written once; texts are gone through while these are made only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = text.tfidf_index(docs, "doc_id")
    assert not set(index.inputFiles()) & set(docs.inputFiles()) and index.count() > 0


def test_pairs_are_not_gathered_before_they_are_shuffled(spark):
    """A task that reads postings holds no (query, document) pairs: nothing is grouped between the index and the exchange."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = retrieval.write_index(docs, "doc_id", new_path(spark))
    _, pairs = retrieval.candidates(index, retrieval.query_vectors(index, items, "item_id"), 3, 0.05)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("Exchange hashpartitioning(query")
    assert "Aggregate" in plan[:dealt] and "Aggregate" not in plan[dealt:] and "Join" in plan[dealt:]
