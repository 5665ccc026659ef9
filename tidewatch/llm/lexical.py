"""Ranked lexical search, a term at a time, with a limit on accumulators.

Each query text ranks all documents by a sum over its distinct terms. Queries are taken in blocks of about ``BLOCK_TERMS``
terms (each once against all documents), so what driver and tasks hold of them is bounded.

1. One pass over the texts writes, for each document, its number of terms and the counts of those that queries have. Document
   frequencies are counted from that table.
2. Each task goes through the documents of its split, some thousand at a time, with postings of their own: for a query, terms
   come rarest first, each adding to the accumulators of its documents. Once the bounds of the remaining terms (their
   greatest contributions) together stay below the k-th partial score, no accumulator is created any more; those there are
   that can still reach it go on and end with exact scores. A task's k-th score so far is the bar for its next documents.
3. The tasks' best ``k`` of each query meet in one window by query.

Dropping is exact: a document without an accumulator scores less than k others. Equal scores go to the smaller doc_id.

Nulls and odd input: null texts and texts without terms are no documents and rank nothing; a null doc_id ranks behind equal
scores; rows of equal doc_id, and query rows of equal item_id, are rows of their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, materialize, sized_join

K = 50
BLOCK_TERMS = 200_000
#: Maximal runs of ASCII letters and digits and of all other characters; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEPT).split() if text else []


def _counted(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id, n and the query terms of each document with their counts."""
    size = max(1, len(number))
    for batch in batches:
        for b in blocks(batch):
            found = [terms_of(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(ws) for ws in found], np.int64)
            known = [np.fromiter(filter(None, map(number.get, ws)), np.int64) for ws in found]  # numbers start at 1
            rows = np.repeat(np.arange(len(found)), [len(x) for x in known])
            pairs, tf = np.unique(rows * (size + 1) + np.concatenate(known), return_counts=True)
            ends = np.cumsum([0, *np.bincount(pairs // (size + 1), minlength=len(found))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(pairs % (size + 1), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])


class Best:
    """The k highest of the scores seen so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_block(lists: dict[int, tuple[np.ndarray, np.ndarray]], query: list[int], ids: np.ndarray, best: Best) -> int:
    """Add the documents ``ids`` to ``best``; ``lists`` has places and contributions by term, ``query`` terms rarest first.
    Returns the number of accumulators created."""
    opened = [lists[t] for t in query if t in lists]
    rest = np.cumsum([int(c.max()) for _, c in opened][::-1])[::-1].tolist() + [0]
    total, bar = np.zeros(len(ids), np.int64), best.bar
    alive = None
    for j, (at, c) in enumerate(opened):
        if alive is None and rest[j] < bar:
            alive = (total > 0) & (total + rest[j] >= bar)
        if alive is None:
            total[at] += c
            done = rest[0] - rest[j + 1]
            if rest[j + 1] and done >= rest[j + 1] and len(ids) >= best.k:  # else the bar can't pass what is left
                bar = max(bar, int(np.partition(total, len(ids) - best.k)[len(ids) - best.k]))
        else:
            own = alive[at]
            total[at[own]] += c[own]
    created = int(np.count_nonzero(total))
    reach = np.flatnonzero(total >= bar) if alive is None else np.flatnonzero(alive & (total >= bar))
    if len(reach) > best.k:  # ties at the k-th stay in
        kth = np.partition(total[reach], len(reach) - best.k)[len(reach) - best.k]
        reach = reach[total[reach] >= kth]
    best.add(total[reach], ids[reach])
    return created


def _searched(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    best = {no: Best(k) for no, _ in queries}
    for b in batches:
        null = np.asarray(b.column("doc_id").is_null())
        ids = np.where(null, _LAST, b.column("doc_id").fill_null(0).to_numpy())
        m = 50 + 50 * b.column("n").to_numpy() * n_docs // n_terms
        terms, tf = b.column("terms").flatten().to_numpy(), b.column("tfs").flatten().to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(b.num_rows), np.diff(b.column("terms").offsets.to_numpy()))
        order = np.argsort(terms, kind="stable")
        terms, tf, rows = terms[order], tf[order], rows[order]
        given = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[rows]))
        first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
        lists = {t: (rows[a:z], given[a:z]) for t, a, z in zip(terms[first].tolist(), first.tolist(), np.append(first[1:], len(terms)).tolist())}
        for no, query in queries:
            search_block(lists, query, ids, best[no])
    found = [(no, i, s) for no, x in best.items() for i, s in zip(x.ids.tolist(), x.scores.tolist())]
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int64()), pa.array([None if f[1] == _LAST else f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
        names=["no", "doc_id", "score"])


def _block_found(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """no, doc_id, score: each task's best ``k`` for each of a bounded number of ``items`` (no, text)."""
    asked = {r.no: sorted(set(terms_of(r.text.encode()))) for r in items.filter("text is not null").collect()}
    vocabulary = sorted({t for ts in asked.values() for t in ts})
    number = {t: i for i, t in enumerate(vocabulary, 1)}
    texts = docs.select("doc_id", "text")
    counted = materialize(texts.mapInArrow(lambda batches: _counted(batches, number), "doc_id long, n long, terms array<int>, tfs array<int>"))
    sizes = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = sizes[0], sizes[1] or 0
    df = {r[0]: r[1] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for t, n in df.items():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    queries = [(no, sorted((number[t] for t in ts if weights[number[t]] > 0), key=lambda t: (df[t], t))) for no, ts in asked.items()]
    there = counted.filter(F.size("terms") > 0)
    return there.mapInArrow(lambda batches: _searched(batches, queries, weights, n_docs, n_terms, k), "no long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` the ``k`` documents with the highest scores above 0."""
    numbered = materialize(items.select("item_id", "text").withColumn("no", F.monotonically_increasing_id()))
    size = numbered.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    n_blocks = max(1, -(-size // block_terms))
    found = None
    for i in range(n_blocks):
        part = _block_found(docs, numbered.filter(F.pmod(F.xxhash64("no"), F.lit(n_blocks)) == i), k)
        found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return sized_join(ranked, numbered.select("no", "item_id"), ["no"], "inner").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = rf"""with d as (select row_number() over () as rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as terms from documents),
size as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from d where len(terms) > 0),
tf as (select rid, term, count(*) as tf from (select rid, unnest(terms) as term from d) group by 1, 2),
df as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, size group by term, n_docs),
m as (select rid, doc_id, 50 + (50 * len(terms) * n_docs) // n_terms as m from d, size where len(terms) > 0),
item as (select row_number() over () as no, item_id, text from benchmark),
asked as (select distinct no, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as term from item),
scored as (select no, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from asked join df using (term) join tf using (term) join m using (rid) group by 1, 2),
ranked as (select no, doc_id, score, row_number() over (partition by no order by score desc, doc_id nulls last)::int as rank from scored join m using (rid) where score > 0)
select item_id, rank, doc_id, score from ranked join item using (no) where rank <= {K}"""
