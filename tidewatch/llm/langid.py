"""Language identification by rank-order profiles.

A profile is the ranked list of a language's most frequent n-grams (1 to 3 characters of lower-cased words, with a mark at
word ends). A document's own most frequent n-grams are ranked the same way and compared to each profile by the
out-of-place measure: the sum of rank differences, with the longest distance for n-grams that a profile lacks.

Profiles are learned from at most ``TRAIN_DOCS`` documents per language (a documented bound: those with the smallest
xxhash64 of doc_id, so any order or partitioning gives the same). The profiles are broadcast: ``PROFILE`` n-grams for each
language, and languages are bounded by ``MAX_LANGS``, beyond which learning fails rather than dropping any.

Nulls and odd input: null texts and texts without a letter are ``und`` with score 0; rows with null lang or doc_id teach nothing;
without any row to learn from every document is ``und``; repeated rows each get a row; an empty table gives an empty
result; ties go to the smaller n-gram and to the first language by name. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, sized_join

TRAIN_DOCS = 2000
PROFILE = 400
MAX_LANGS = 500
UNKNOWN = "und"
HELD_OUT = 2
#: Characters of a document that are looked at in one piece; counts of pieces are added.
PIECE = 200_000

_LETTER = np.zeros(0x110000, bool)
_LOW = np.arange(0x110000, dtype=np.uint32)


def _tables() -> None:
    if not _LETTER.any():
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                _LETTER[i] = True
                low = c.lower()
                if len(low) == 1:
                    _LOW[i] = ord(low)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of ``text`` and their counts.

    A code holds up to three characters of 21 bits, 0 for a word end; the top bit marks pairs, so that they differ from
    the triples that start with a word end. Triples have a letter in the middle and another beside it.
    """
    _tables()
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for start in range(0, len(text), PIECE):
        low = max(0, start - 2)  # n-grams that end here but start in the last piece
        u = np.frombuffer(text[low : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.where(_LETTER[u], _LOW[u], 0).astype(np.uint64)
        x = np.concatenate((np.zeros(2 if start == 0 else 2 - (start - low), np.uint64), x))
        if start + PIECE >= len(text):
            x = np.append(x, np.uint64(0))
        a, m, z = x[:-2], x[1:-1], x[2:]
        two = ((m << np.uint64(21)) | z | np.uint64(1 << 63))[(m != 0) | (z != 0)]
        three = ((a << np.uint64(42)) | (m << np.uint64(21)) | z)[(m != 0) & ((a != 0) | (z != 0))]
        c, n = np.unique(np.concatenate((z[z != 0], two, three)), return_counts=True)
        codes, at = np.unique(np.concatenate((codes, c)), return_inverse=True) if start else (c, None)
        counts = np.bincount(at, np.concatenate((counts, n))).astype(np.int64) if start else n
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; ties to the smaller code."""
    if len(codes) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        use = counts >= floor
        codes, counts = codes[use], counts[use]
    return codes[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        every = np.array(sorted({c for p in profiles.values() for c in p}), np.uint64)
        self.codes = every
        self.ranks = np.full((len(self.langs), len(every) + 1), -1, np.int64)
        for k, name in enumerate(self.langs):
            p = np.array(profiles[name], np.uint64)
            self.ranks[k, np.searchsorted(every, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        codes, counts = ngrams(text)
        if not len(codes):
            return UNKNOWN, 0.0
        top = ranked(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        there = np.where(self.codes[at] == top, at, len(self.codes))
        r = self.ranks[:, there]
        places = np.where(r < 0, PROFILE, np.abs(r - np.arange(len(top))))
        distance = places.sum(axis=1) / (PROFILE * len(top))
        near = 1 - distance
        best = int(np.argmin(distance))
        total = near.sum()
        return self.langs[best], float(near[best] / total) if total > 0 else 0.0


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def learn(docs: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, list[int]]:
    """Profiles by language from the documents that are not held out."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != HELD_OUT))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= train_docs)
    sample = sized_join(rows, materialize(ids.select("doc_id", F.col("lang").alias("of"))), ["doc_id"], "inner").filter("lang = of")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, []).append(ngrams(text))
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([k for _, k in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    sums = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = sums.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= size).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("p"))
    found = best.limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return {r.lang: [x.code & (2**64 - 1) for x in r.p] for r in found}


def predictions(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for b in batches:
            found = [model.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", (remainder("doc_id", 4) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predictions(docs, learn(docs))
