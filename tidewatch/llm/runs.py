"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q and at least ``max(least, 2 * q)`` words that no neighbouring word
extends. Texts are taken in blocks of whole documents; each document's words have names of their own, so nothing matches
across documents.

1. Names of the blocks of 1, 2, 4, ... words at each place come by doubling; what occurs once drops out of the next
   round. Their order gives the suffix array of the places whose four words come again, in which equal blocks stand side by side.
2. A wavelet matrix over that array answers range successor: the first occurrence of a block at or after a place. Each
   dyadic block (four words at every second place, 2**k at every 2**k-th) asks for its occurrences in the windows behind it
   that are as wide as itself: blocks of 2**k words for the distances of 2**(k+1) - 1 to 2**(k+2) - 2, those of four for 1 to 14.
   A run with period q holds such a block and its copy q words on.
3. Three and more occurrences in one window are an arithmetic progression whose difference is the block's period, so its
   first, second and last member stand for all. Members in the block's own run of that period are no new periods.
4. Each distance that is left is extended to both sides by the names (longest common extensions) and kept if it is a run;
   of several periods of one stretch the smallest counts.

Time is n log n in the words of a block, which has ``BLOCK_CHARS`` characters of text or one longer document; so is memory.

Nulls and odd input: a null text has no words, thus no runs, and collapses to an empty text; a null doc_id is kept; rows
of equal doc_id are rows of their own; an empty table gives an empty result; extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import WORD, blocks, let, text_or_empty

LEAST = 12
BLOCK_CHARS = 1_500_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Wavelet:
    """Wavelet matrix of a permutation of 0..m-1."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for k in reversed(range(self.bits)):
            bit = (values >> k) & 1 == 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[~bit], values[bit]))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at [low, high) are smaller than ``x``."""
        found = np.where(x >> self.bits > 0, high - low, 0)
        for k, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            a, z = ones[low], ones[high]
            bit = (x >> k) & 1 == 1
            found = np.where(bit & (x >> self.bits == 0), found + (high - low) - (z - a), found)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + z, high - z)
        return found

    def ranked(self, low: np.ndarray, high: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The value at [low, high) that has ``r`` smaller ones there."""
        value = np.zeros_like(r)
        for ones, zeros in zip(self.ones, self.zeros):
            a, z = ones[low], ones[high]
            none = (high - low) - (z - a)
            bit = r >= none
            value, r = 2 * value + bit, np.where(bit, r - none, r)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + z, high - z)
        return value


class Dictionary:
    """Names of all blocks of 2**k words of ``ids``, in which equal words have equal ids of 0..n-1 and the last is unique."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.levels = [ids.astype(np.int32)]
        #: level, place, slot and size of its group for the places whose block comes again
        self.repeated: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        at = slots = np.arange(n)
        name = ids
        while len(at):
            k = len(self.levels) - 1
            key = name[at] * n + name[np.minimum(at + (1 << k), n - 1)]
            order = np.argsort(key)
            key, at = key[order], at[order]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(head)
            sizes = np.diff(np.append(first, len(at)))
            group = np.cumsum(head) - 1
            name = name.copy()
            name[at] = slots[first][group]
            size = sizes[group]
            again = size > 1
            at, slots, size = at[again], slots[again], size[again]
            if len(at):
                self.levels.append(name.astype(np.int32))
                if k >= 1:
                    self.repeated.append((k + 1, at, name[at], size))
        self.final = name

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` on are equal."""
        began = i
        for k in reversed(range(len(self.levels))):
            same = self.levels[k][i] == self.levels[k][j]
            i, j = i + (same << k), j + (same << k)
        return i - began

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words that end with those at ``i`` and ``j`` are equal."""
        began = i
        for k in reversed(range(len(self.levels))):
            a, z = i - (1 << k) + 1, j - (1 << k) + 1
            same = (a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(z, 0)])
            i, j = i - (same << k), j - (same << k)
        return began - i


def candidates(d: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which a dyadic block comes again, of the distances that its size stands for."""
    none = np.zeros(0, np.int64)
    if not d.repeated:
        return none, none
    places = np.sort(d.repeated[0][1])
    by_slot = places[np.argsort(d.final[places])]
    slots = d.final[by_slot]
    w = Wavelet(np.searchsorted(places, by_slot))
    taken = []
    for k, at, name, size in d.repeated:
        own = at % (2 if k == 2 else 1 << k) == 0
        at, size = at[own], size[own]
        low = np.searchsorted(slots, name[own])
        least, most = (1, 14) if k == 2 else ((2 << k) - 1, (4 << k) - 2)
        taken.append((at, np.full(len(at), 1 << k), at + least, at + most, low, low + size))
    b, length, near, far, low, high = (np.concatenate(x) for x in zip(*taken))
    after = near
    found_b, found_q = [], []

    def first_at(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Range successor: the first place from ``x`` on; beyond all places if there is none."""
        r = w.below(low, high, np.searchsorted(places, x))
        there = r < high - low
        return np.where(there, places[w.ranked(low, high, np.minimum(r, high - low - 1))], 1 << 60)

    while len(b):
        p = first_at(after, low, high)
        b, length, near, far, low, high, p = (x[p <= far] for x in (b, length, near, far, low, high, p))
        if not len(b):
            break
        end = np.minimum(near + ((p - near) // length + 1) * length, far + 1)
        second = first_at(p + 1, low, high)
        found_b.append(b), found_q.append(p - b)
        more = second < end
        if more.any():
            b2, p2, s2, l2, h2 = (x[more] for x in (b, p, second, low, high))
            last = places[w.ranked(l2, h2, w.below(l2, h2, np.searchsorted(places, end[more])) - 1)]
            step = s2 - p2
            # members in the block's own run of period ``step`` bring nothing; of two members both are taken
            whole = np.where(last > s2, b2 + step + d.forward(b2, b2 + step) - length[more], -1)
            skip = np.where(whole >= p2, (whole - p2) // step + 1, 1)  # the first is taken above
            count = np.maximum((last - p2) // step + 1 - skip, 0)
            ends = np.cumsum(count)
            t = np.repeat(skip - (ends - count), count) + np.arange(ends[-1])
            found_b.append(np.repeat(b2, count)), found_q.append(np.repeat(p2 - b2, count) + t * np.repeat(step, count))
        after = end
        on = after <= far
        b, length, near, far, low, high, after = (x[on] for x in (b, length, near, far, low, high, after))
    return (np.concatenate(found_b), np.concatenate(found_q)) if found_b else (none, none)


def runs_of(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start and period. ``least`` is at least 9, else short runs hold no block."""
    if least < 9:
        raise ValueError("runs of fewer than 9 words are not looked for")
    d = Dictionary(ids)
    b, q = candidates(d)
    end = b + q + d.forward(b, b + q)
    start = b - d.backward(b - 1, b + q - 1)
    long = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(q)]
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def runs_of_texts(texts: list[bytes | None], least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """For each text its runs (start, length, period) and the words outside all runs' repeats, with single spaces."""
    words = [t.split() if t else [] for t in texts]  # of bytes: at ASCII white space alone
    offsets = np.cumsum([0, *[len(ws) + 1 for ws in words]])
    ids = np.empty(offsets[-1], np.int64)
    for ws, o in zip(words, offsets.tolist()):
        n, first = len(ws), {}
        ids[o : o + n] = np.fromiter(map(first.setdefault, ws, range(o, o + n)), np.int64, n)
        ids[o + n] = o + n  # an end of its own
    start, end, period = runs_of(ids, least)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    doc = np.searchsorted(offsets, start, side="right") - 1
    for k, s, n, q in zip(doc.tolist(), (start - offsets[doc]).tolist(), (end - start).tolist(), period.tolist()):
        found[k].append((s, n, q))
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    kept = np.cumsum(dropped) == 0
    return found, [b" ".join(compress(ws, kept[o : o + len(ws)].tolist()) if r else ws) for ws, r, o in zip(words, found, offsets.tolist())]


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for b in blocks(batch, BLOCK_CHARS):
            found, collapsed = runs_of_texts(b.column("text").cast(pa.binary()).to_pylist(), least)
            flat = np.array([r for rs in found for r in rs], np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(item))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), each), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc (a struct of the columns of ``docs`` but text), runs (start, length and period in words, by start and period) and
    collapsed (the words that no run contains after its first period, with single spaces)."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    d = docs.select(kept, "text")
    schema = T.StructType([d.schema["doc"], *T.StructType.fromDDL(f"runs {RUNS}, collapsed string").fields])
    return d.mapInArrow(lambda batches: _found(batches, least), schema)


def made_periodic(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth text (by the checksum h of its id, g = h div 10) repeats a stretch: of its n words, those
    from a = g mod n on become the first 1 + (n - a) div (3 + g mod 8) of them over and over. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    made = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda words: F.when(F.size(words) > 0, changed(words)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period; null if there
    is none) and the SHA-256 of all runs and of the collapsed text, of ``made_periodic`` texts."""
    found = periodic_runs(made_periodic(docs))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(text_or_empty("collapsed"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Stretches of equal words q apart hold six words that come again after q, as a run has six words more than q at least.
ORACLE_SQL = rf"""with recursive crc_table(i, v, k) as (select range, range, 0 from range(256)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from crc_table where k < 8),
ids as (select distinct doc_id, doc_id::varchar as s from documents where doc_id is not null),
crc(doc_id, s, pos, c) as (select doc_id, s, 1, 4294967295 from ids
  union all select doc_id, s, pos + 1, xor(c >> 8, v) from crc join crc_table on k = 8 and i = xor(c & 255, ascii(s[pos])) where pos <= length(s)),
h as (select doc_id, xor(c, 4294967295) as h from crc where pos = length(s) + 1),
w0 as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w1 as (select rid, w0.doc_id, words, len(words) as n, h, (h // 10) % greatest(len(words), 1) as a, (h // 10) % 8 as g8 from w0 left join h using (doc_id)),
w as (select rid, doc_id, n, case when h % 10 = 0 and n > 0
  then list_transform(range(n), lambda i: case when i < a then words[i + 1] else words[a + (i - a) % (1 + (n - a) // (3 + g8)) + 1] end) else words end as words from w1),
six as (select rid, n, i, array_to_string(words[i + 1:i + 6], ' ') as g from (select rid, n, words, unnest(range(n - 5)) as i from w)),
same as (select x.rid, x.i, y.i - x.i as q from six x join six y on x.rid = y.rid and x.g = y.g and x.i < y.i and 2 * (y.i - x.i) <= x.n),
island as (select rid, q, i, i - row_number() over (partition by rid, q order by i) as part from same),
stretch as (select rid, q, min(i) as start, count(*) + 5 + q as length from island group by rid, q, part),
run as (select rid, start, length, min(q) as period from stretch where length >= greatest({LEAST}, 2 * q) group by 1, 2, 3),
digest as (select rid, count(*) as n_runs, min((-length, start, period)) as best, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines
  from run group by rid),
gone as (select distinct rid, unnest(range(start + period, start + length)) as i from run),
kept as (select rid, string_agg(words[i + 1], ' ' order by i) as collapsed
  from (select rid, words, unnest(range(n)) as i from w) anti join gone using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0) as n_runs, best[2] as start, -best[1] as length, best[3] as period, 1000 * -best[1] // best[3] as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from w left join digest using (rid) left join kept using (rid)"""
