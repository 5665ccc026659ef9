"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import uuid

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import langid, licences, mixing, near_dup, pieces, pii, quality, token_files, toxicity, vector_search
from tidewatch.llm.common import shared_dir

from .conftest import edge_rows

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def labels_of(docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))


OPERATORS = {
    "licences": licences.licence_scan,
    "near_dup": near_dup.near_duplicates,
    "quality": quality.quality_verdicts,
    "token_files": lambda d: token_files.token_digests(d, f"{shared_dir(d.sparkSession)}/{uuid.uuid4().hex}", BPE),
    "language": langid.identify,
    "toxicity": lambda d: toxicity.toxicity(d, labels_of(d)),
    "pieces": lambda d: pieces.piece_digests(d, SP),
    "pii": pii.personal_data,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, edge):
    rows = OPERATORS[name](edge).collect()
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    assert ids == sorted((r[0] is not None, r[0] or 0) for r in edge_rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


def test_values_of_edge_rows(edge):
    by = lambda name: {r.doc_id: r for r in OPERATORS[name](edge.filter("doc_id is not null and doc_id <> 5")).collect()}
    assert [by("licences")[i].n_passages for i in (1, 2, 8)] == [0, 0, 0]
    near = by("near_dup")
    assert [near[i].n_shingles for i in (1, 2, 3, 8, 9)] == [0, 0, 0, 1, 1]
    assert all(r.component_id == r.doc_id and r.kept for r in near.values())
    q = by("quality")
    assert [q[i].n_words for i in (1, 2, 3, 8)] == [0, 0, 0, 1] and not q[1].kept and q[1].base_failed
    assert [by("token_files")[i].n_tokens for i in (1, 2)] == [1, 1]
    lang = by("language")
    assert [lang[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in lang.values())
    tox = by("toxicity")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in tox.values())
    p = by("pieces")
    assert [p[i].n_pieces for i in (1, 2)] == [0, 0] and all(r.round_trip for r in p.values())
    found = by("pii")
    assert [found[10][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1] and found[1].spans == ""


def test_repeated_rows_link_by_their_own_texts(edge):
    rows = near_dup.near_duplicates(edge.filter("doc_id in (5, 6)")).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (5, 5), (6, 5)]


def test_null_ids_never_name_a_component(edge):
    rows = near_dup.near_duplicates(edge.filter("doc_id is null or doc_id = 6")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, 6), (6, 6)}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, edge, empty):
    assert stage(spark, empty, "").collect() == []
    out = stage(spark, edge, "")
    assert out.count() > 0
    if stage is not corpus_pipeline.encoding:
        assert out.columns == edge.columns


def test_deduplicated_keeps_one_row_of_each_group(edge):
    rows = near_dup.deduplicated(edge.filter("doc_id in (5, 6) or doc_id is null")).collect()
    assert sorted(r.text[:11] for r in rows) == ["another tex", "word0 of0 w"]


def test_mixing_edges(edge, empty):
    assert mixing.mix_sources(empty).collect() == []
    rows = mixing.mix_sources(edge).collect()
    assert rows and {r.epoch for r in rows} <= {0, 1}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (100, [0.5, -1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 1.0, 1.0]), (7, [0.5, 0.25]), (8, [0.5, 0.25]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("z")).withColumn("dim", F.lit("z"))
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_search.top_k(v).collect()}
    s = 512 * 512 + 256 * 256
    assert [found[0, k] for k in (1, 2)] == [(7, s), (8, s)] and found[0, 3] == (100, 512 * 512 - 256 * 1024) and (0, 4) not in found
    assert [found[100, k][0] for k in (1, 2, 3, 4)] == [0, 0, 7, 8]
    assert vector_search.top_k(v.limit(0)).collect() == []
