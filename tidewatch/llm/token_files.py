"""Token ids in grammar-compressed shards.

Documents are range-partitioned and sorted by id, encoded, and packed into shards of about ``SHARD_TOKENS`` ids (a longer
document is a shard of its own). Each shard is compressed by Re-Pair: rounds replace the most frequent pairs of adjacent
symbols by new nonterminals, never across the end of a document. As an exact round per pair would pass over a shard
thousands of times, a round replaces up to ``PAIRS`` pairs at once; where chosen pairs overlap, the leftmost wins. A pair
below ``MIN_COUNT`` occurrences is no rule, as a rule takes 12 bytes and each use of it saves 2.

A file is a Parquet folder with one row per shard: doc ids, their token counts and first symbols, the symbols (unsigned
16 bits) and the rules. Rule r defines symbol ``base + r`` as two earlier symbols and stores its expansion length, so a
document, or any token of it, is decoded from its own symbols alone (``read_document``, ``token_at``). Vocabularies of
more than 65,536 ids do not fit the symbols and raise.

Encoding cuts texts before single white-space characters (a space or a line end), where the vocabulary's pre-tokenizer
always cuts, and hands each distinct piece to the tokenizers library once while it stays in a bounded cache. Texts in which white space follows white space, that start or end with it, or
which hold other white space or the special token's string go whole to the library.

Nulls and odd input: a null text is empty (its ids are the end id alone); null doc_ids come first; rows of equal doc_id
are ordered by text; an empty table gives an empty file and result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BLOCK_CHARS, blocks, sized_join

SHARD_TOKENS = 1 << 20
ROUNDS = 5
PAIRS = 1024
MIN_COUNT = 8
END_ID = 0
CACHE_PIECES = 1_200_000
#: Bytes of text that a writing task gets at most, about.
PART_BYTES = 128 << 20
SHARD_SCHEMA = (
    "part int, seq int, before long, n_tokens long, least_id long, most_id long, doc_ids array<long>, counts array<long>, "
    "first_symbols array<long>, base int, symbols binary, rules binary"
)
#: Texts that go whole to the library: all white space but single spaces and line ends inside, and the special token.
_WHOLE = r"[ \n]{2}|^[ \n]|[ \n]$|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|endoftext\|>"


class Encoder:
    """Byte-level BPE ids of whole texts as unsigned 16-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        if self.vocab_size > 1 << 16:
            raise ValueError(f"{self.vocab_size} ids do not fit 16-bit symbols")
        self.byte_lengths = np.zeros(self.vocab_size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # a character of a byte-level token stands for a byte
            self.byte_lengths[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, pieces: list[str]) -> None:
        """New pieces, with the space before those that are not at a line's start, put into the pool."""
        texts = [w if w[0] == "\n" else " " + w for w in pieces]
        sizes = pc.binary_length(pa.array(texts)).to_numpy()
        flat, lengths = [self.pool], []
        for k in range(0, len(texts), 2000):
            ids = self.library(["".join(texts[k : k + 2000])])[0]
            ends = np.cumsum(self.byte_lengths[ids])
            cuts = np.searchsorted(ends, np.cumsum(sizes[k : k + 2000])) + 1
            flat.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.pool = np.concatenate(flat)
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        rest = iter(self.library(texts.filter(pa.array(whole)).to_pylist()))
        found = iter(self.plain(texts.filter(pa.array(~whole))))
        return [next(rest) if w else next(found) for w in whole.tolist()]

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        # pieces start at each space or line end; a text's first piece has neither and goes to the library
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = np.zeros(len(which), bool)
        first[at[:-1]] = True
        used = np.zeros(len(words), bool)
        used[which[~first]] = True
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(used & (number < 0))
        if len(self.number) + len(new) > CACHE_PIECES:
            self._clear()
            number[:] = -1
            new = np.flatnonzero(used)
        if len(new):
            number[new] = len(self.number) + np.arange(len(new))
            self.add([words[i] for i in new.tolist()])
        row = np.where(first, 0, number[which])  # a first piece has no ids here
        low = self.starts[row]
        n = np.where(first, 0, self.starts[np.minimum(row + 1, len(self.starts) - 1)] - low)
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(low - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.concatenate(([0], ends))[at].tolist()
        heads = self.library([words[i] for i in which[at[:-1]].tolist()])
        return [np.concatenate((h, ids[a:b])) for h, a, b in zip(heads, cuts, cuts[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _perfect(codes: np.ndarray) -> tuple[np.ndarray, np.uint32]:
    """A table from the upper 20 bits of code * factor to the code's place (-1: none), and a factor without collisions."""
    factor = np.uint32(2654435761)
    while True:
        at = (codes * factor) >> np.uint32(12)
        table = np.full(1 << 20, -1, np.int16)
        table[at] = np.arange(len(codes))
        if (table[at] == np.arange(len(codes))).all():
            return table, factor
        factor += np.uint32(2)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int = ROUNDS, pairs: int = PAIRS, min_count: int = MIN_COUNT):
    """Re-Pair of ``ids`` (uint16); ``ends`` has the places of the documents' last ids. Returns symbols, rules as rows
    (left, right, length) and the places of the documents' last symbols."""
    symbols, rules, lengths, none = ids.astype(np.uint32), [], np.ones(base, np.int64), np.uint32(2**32 - 1)
    for _ in range(rounds):
        room = min(pairs, 65535 - base - len(rules))  # symbol 65535 stays free, for ``none``
        if len(symbols) < 2 or room <= 0:
            break
        codes = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        codes[ends[:-1]] = none
        ordered = np.sort(codes)[: len(codes) - len(ends) + 1]
        if not len(ordered):
            break
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        if len(often) > room:  # the most frequent; ties to the smaller pair
            often = often[np.argsort(-counts[often], kind="stable")[:room]]
        chosen = np.sort(ordered[starts[often]])
        table, factor = _perfect(chosen)
        which = table[(codes * factor) >> np.uint32(12)]
        at = np.flatnonzero(which >= 0)
        which = which[at]
        hit = chosen[which] == codes[at]
        at, which = at[hit], which[hit]
        # in a run of overlapping occurrences take every other one, from the left
        new_run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        place = np.arange(len(at))
        take = (place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0
        at, which = at[take], which[take]
        n = base + len(rules)
        left, right = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        made = lengths[left] + lengths[right]
        rules.extend(zip(left.tolist(), right.tolist(), made.tolist()))
        lengths = np.concatenate((lengths, made))
        symbols[at] = n + which.astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        ends = ends - np.searchsorted(at + 1, ends, side="right")
    return symbols.astype("<u2"), np.array(rules, dtype="<u4").reshape(-1, 3), ends


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of ``symbols``."""
    lengths = np.concatenate((np.ones(base, np.int64), rules[:, 2].astype(np.int64)))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.empty(offsets[-1], np.uint16)
    flat[:base] = np.arange(base)
    for r, (a, b, _) in enumerate(rules.tolist()):  # parts come before the whole
        o, la = offsets[base + r], lengths[a]
        flat[o : o + la] = flat[offsets[a] : offsets[a] + la]
        flat[o + la : offsets[base + r + 1]] = flat[offsets[b] : offsets[b] + lengths[b]]
    each = lengths[symbols]
    ends = np.cumsum(each)
    return flat[np.repeat(offsets[symbols] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]


def expand_few(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """As ``expand``, by way of the rules that ``symbols`` use alone."""
    symbols = symbols.astype(np.int64)
    while (high := symbols >= base).any():
        each = 1 + high
        ends = np.cumsum(each)
        out = np.repeat(symbols, each)
        pairs = rules[symbols[high] - base]
        out[ends[high] - 2], out[ends[high] - 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols.astype(np.uint16)


def document_symbols(shard: dict, k: int) -> np.ndarray:
    """The symbols of the ``k``-th document of a shard's row."""
    first = shard["first_symbols"]
    end = 2 * first[k + 1] if k + 1 < len(first) else None
    return np.frombuffer(shard["symbols"][2 * first[k] : end], "<u2")


def token_at(shard: dict, k: int, position: int) -> int:
    """One id of a shard's ``k``-th document, by expansion lengths: down the grammar from the symbol that covers it."""
    symbols, rules, base = document_symbols(shard, k), np.frombuffer(shard["rules"], "<u4").reshape(-1, 3), shard["base"]
    high = symbols >= base
    lengths = np.ones(len(symbols), np.int64)
    lengths[high] = rules[symbols[high] - base, 2]
    ends = np.cumsum(lengths)
    at = int(np.searchsorted(ends, position, side="right"))
    symbol, position = int(symbols[at]), position - int(ends[at] - lengths[at])
    while symbol >= base:
        left, right, _ = map(int, rules[symbol - base])
        n = int(rules[left - base, 2]) if left >= base else 1
        symbol, position = (left, position) if position < n else (right, position - n)
    return symbol


def _shards(batches: Iterator[pa.RecordBatch], path: str, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    enc, part, seq, before = encoder(path), TaskContext.get().partitionId(), 0, 0
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0
    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("least_id", pa.int64()), ("most_id", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("first_symbols", pa.list_(pa.int64())), ("base", pa.int32()),
        ("symbols", pa.binary()), ("rules", pa.binary())])

    def shard() -> pa.RecordBatch:
        counts = np.array([len(x) for _, x in held], np.int64)
        ids = np.concatenate([x for _, x in held])
        symbols, rules, ends = compress(ids, np.cumsum(counts) - 1, enc.vocab_size)
        first = np.concatenate(([0], ends[:-1] + 1))
        there = [d for d, _ in held if d is not None]
        row = {
            "part": part, "seq": seq, "before": before, "n_tokens": len(ids), "least_id": min(there, default=None), "most_id": max(there, default=None),
            "doc_ids": [d for d, _ in held], "counts": counts.tolist(), "first_symbols": first.tolist(), "base": enc.vocab_size,
            "symbols": symbols.tobytes(), "rules": rules.tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    end = np.array([END_ID], np.uint16)
    for batch in batches:
        for b in blocks(batch, 4 * BLOCK_CHARS):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc(b.column("text"))):
                n = len(ids) + 1
                if held and size + n > shard_tokens:
                    yield shard()
                    held, seq, before, size = [], seq + 1, before + size, 0
                held.append((doc_id, np.concatenate((ids, end))))
                size += n
    if held:
        yield shard()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, shard_tokens: int = SHARD_TOKENS, part_bytes: int = PART_BYTES) -> None:
    """Encode ``docs`` and write them to ``path`` (any file system that Spark writes), ascending by doc_id.

    There are as many tasks as the session shuffles to, and more where a task would get more than ``part_bytes``.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _shards(batches, vocabulary, shard_tokens), SHARD_SCHEMA).write.parquet(path)


def part_starts(shards: DataFrame) -> DataFrame:
    """part, part_start: the ids before each part. One row per writing task meets the window."""
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 3)
            ids = expand(np.frombuffer(r["symbols"], "<u2"), rules, r["base"]).astype("<u4")
            ends = np.cumsum(np.array(r["counts"], np.int64))
            starts = np.concatenate(([0], ends[:-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["part_start"] + r["before"], pa.int64()), pa.array(r["counts"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                    pa.array([ids[a:b] for a, b in zip(starts, ends)], pa.list_(pa.int32())) if r["with_ids"] else pa.nulls(len(ends), pa.list_(pa.int32())),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
            )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (null unless ``with_ids``) from the files at ``path``.

    Only the start of each part is joined to the shards, so no payload is shuffled.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    placed = sized_join(shards, part_starts(shards.select("part", "n_tokens")), ["part"], "inner").withColumn("with_ids", F.lit(with_ids))
    return placed.mapInArrow(_decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """doc_id and ids of the rows of one document: shards are pruned by their range of ids, and only the document's own
    symbols are expanded."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 3)
                ids = [expand_few(document_symbols(r, k), rules, r["base"]) for k, d in enumerate(r["doc_ids"]) if d == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    near = spark.read.schema(SHARD_SCHEMA).parquet(path).filter((F.col("least_id") <= doc_id) & (F.col("most_id") >= doc_id))
    return near.mapInArrow(found, "doc_id long, ids array<int>")


def token_digests(docs: DataFrame, path: str, vocabulary: str) -> DataFrame:
    """Write ``docs`` to ``path`` and digest what is read back: doc_id, start, n_tokens, ids_crc32."""
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path, with_ids=False).drop("ids")
