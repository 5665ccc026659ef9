"""Packing token sequences into windows by non-negative least squares on the histogram of lengths.

1. Texts are encoded once and written with their number among the task's documents of equal rest, which is the length after
   as many whole windows as fit. Whole windows are sequences of their own.
2. Over the histogram of rests (at most ``window - 1`` counts, whatever the corpus) all combinations of up to three lengths
   that fill a window are enumerated, and their repeat counts solved by non-negative least squares (active sets, several
   columns a round). Counts are rounded, within what the histogram has.
3. What is left is packed greedily, still by counts: the longest length, then the longest that fits, and so on, as often
   as the counts allow; a gap in which nothing fits is filled by cutting the longest piece left. The last tokens, fewer than
   a window, are cut at powers of two. So no sequence but these is shorter than a window, and none needs padding.
4. The plan is a bounded list of rules: members a to b of a length go to sequences s, s + 1, ... at one offset. A document's
   number within its length is its number within the task's plus the counts of the tasks before it, by one small join.

Nulls and odd input: a null text is empty, its ids are the end id alone; null doc_ids are kept; rows of equal doc_id are rows of
their own; very long texts become many whole windows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BLOCK_CHARS, blocks, materialize, sized_join
from tidewatch.llm.token_files import END_ID, encoder

WINDOW = 1024
#: Columns that a round of the solver adds at most, and rounds.
ADDED, ROUNDS = 48, 120
#: Documents that a task places at once.
PLACED = 2_000
#: Sequences of whole windows have numbers from here on.
WHOLE = 1 << 40
_SHIFT = 44


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All ways to fill ``window`` with one to three of ``lengths``, as rows padded with 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = [np.array([[0, 0, window]])] if there[window] else []
    a = np.flatnonzero(there[: window // 2 + 1])
    a = a[there[window - a] & (a > 0)]
    found.append(np.stack((np.zeros_like(a), a, window - a), axis=1))
    for a in np.flatnonzero(there[: window // 3 + 1]).tolist():
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        b = b[there[b] & there[window - a - b]]
        if a:
            found.append(np.stack((np.full_like(b, a), b, window - a - b), axis=1))
    return np.concatenate(found)


def repeat_counts(columns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative x with the least squared difference of the lengths that ``columns`` use x times and ``histogram``."""
    x, size = np.zeros(len(columns)), len(histogram)
    if not len(columns):
        return x
    h = histogram.astype(float)
    scale = max(1.0, h.max())
    h = h / scale
    support = np.zeros(0, np.int64)

    def used(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        made = np.bincount(rows.ravel(), weights=np.repeat(values, 3), minlength=size)
        made[0] = 0
        return made

    best, still = np.inf, 0
    for _ in range(ROUNDS):
        rest = h - used(x[support], columns[support])
        rest[0] = 0
        loss = float(rest @ rest)
        still = still + 1 if loss > best * 0.995 else 0
        best = min(best, loss)
        gain = rest[columns].sum(axis=1)
        gain[support] = 0
        top = np.argsort(-gain)[: 64 * ADDED]
        new, taken = [], set()
        for i in top[gain[top] > 1e-9].tolist():  # columns without a length in common
            own = set(columns[i].tolist()) - {0}
            if not own & taken:
                new.append(i)
                taken |= own
                if len(new) == ADDED:
                    break
        if not new or still == 4:
            break
        support = np.concatenate((support, np.array(new, np.int64)))
        while len(support):
            a = np.zeros((size, len(support)))
            np.add.at(a, (columns[support], np.arange(len(support))[:, None]), 1)
            a[0] = 0
            z = np.linalg.solve(a.T @ a + 1e-8 * np.eye(len(support)), a.T @ h)
            low = z <= 1e-12
            now = x[support]
            if not low.any():
                x[support] = z
                break
            step = float((now[low] / np.maximum(now[low] - z[low], 1e-300)).min())
            now = now + step * (z - now)
            stay = (now > 1e-12) & ~(low & (now <= 1e-9))
            x[support] = np.where(stay, now, 0)
            support = support[stay]
    return x * scale


class Plan:
    """Rules by length and number: a member's sequence and offset, or its first piece's and the length that it goes on as."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, self.n_sequences, self.n_cut = window, 0, 0
        self.rules: list[tuple[int, int, int, int, int, int, int]] = []  # length, from, sequence, offset, tokens, next length, next from
        self.have = histogram.astype(np.int64).copy()  # of length i; [0] is unused
        self.taken, self.total = np.zeros_like(self.have), self.have.copy()
        columns = combinations(np.flatnonzero(self.have), window)
        x = repeat_counts(columns, self.have)
        for i in np.argsort(-x, kind="stable")[: int(np.count_nonzero(x >= 0.5))].tolist():
            lengths = [n for n in columns[i].tolist() if n]
            times = min([int(x[i] + 0.5), *(int(self.have[n]) // k for n, k in Counter(lengths).items())])
            if times:
                self.put(lengths, times)
        self.solved = self.n_sequences
        self.greedy()
        rules = np.array(sorted(self.rules), np.int64).reshape(-1, 7)
        self.keys = (rules[:, 0] << _SHIFT) | rules[:, 1]
        self.at, self.sequence, self.offset, self.tokens, self.next, self.next_at = rules[:, 1:].T

    def take(self, length: int, times: int, offset: int, tokens: int, goes_on: int = 0) -> None:
        self.rules.append((length, int(self.taken[length]), self.n_sequences, offset, tokens, goes_on, int(self.total[goes_on])))
        self.taken[length] += times
        self.have[length] -= times
        if goes_on:
            self.n_cut += times
            self.total[goes_on] += times
            self.have[goes_on] += times

    def put(self, lengths: list[int], times: int, room: int = 0, donor: int = 0) -> None:
        """``times`` sequences of ``lengths``, and of the first ``room`` tokens of ``donor``."""
        offset = 0
        for n in lengths:
            self.take(n, times, offset, n)
            offset += n
        if room:
            self.take(donor, times, offset, room, donor - room)
        self.n_sequences += times

    def greedy(self) -> None:
        numbers = np.arange(len(self.have))
        while left := int(self.have @ numbers):
            size = self.window
            while size > left:  # the last tokens: by powers of two
                size = 1 << (size - 1).bit_length() - 1
            free, lengths, room = self.have.copy(), [], size
            while room and len(fit := np.flatnonzero(free[: room + 1])):
                n = int(fit[-1])
                k = min(int(free[n]), room // n)
                lengths += [n] * k
                free[n] -= k
                room -= k * n
            donor = int(np.flatnonzero(free)[-1]) if room else 0
            need = Counter(lengths)
            if donor:
                need[donor] += 1
            times = min(int(self.have[n]) // k for n, k in need.items())
            self.put(lengths, max(1, min(times, left // size)), room, donor)

    def pieces(self, length: np.ndarray, number: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Rounds of (member, tokens, sequence, offset): the first piece of each member, then what goes on of those cut."""
        member, out = np.arange(len(length)), []
        while len(member):
            rule = np.searchsorted(self.keys, (length << _SHIFT) | number, side="right") - 1
            along = number - self.at[rule]
            out.append((member, self.tokens[rule], self.sequence[rule] + along, self.offset[rule]))
            on = self.next[rule] > 0
            member, length, number = member[on], self.next[rule][on], self.next_at[rule][on] + along[on]
        return out


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int) -> Iterator[pa.RecordBatch]:
    enc, part, seen, whole = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
    end = np.array([END_ID], np.uint16)
    for batch in batches:
        for b in blocks(batch, 2 * BLOCK_CHARS):
            rows = [np.concatenate((ids, end)) for ids in enc(b.column("text"))]
            n = np.array([len(r) for r in rows], np.int64)
            rest = n % window
            order = np.argsort(rest, kind="stable")
            ordered = rest[order]
            first = np.searchsorted(ordered, ordered)  # the first place of its length
            number = np.empty_like(rest)
            number[order] = seen[ordered] + np.arange(len(n)) - first
            seen += np.bincount(rest, minlength=window)
            before = whole + np.cumsum(n // window) - n // window
            whole += int((n // window).sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(rest), pa.array(number), pa.array(before), pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())],
                names=["part", "doc_id", "n", "rest", "number", "whole_before", "ids"])


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan, with_ids: bool) -> Iterator[pa.RecordBatch]:
    window = plan.window
    for b in (batch.slice(i, PLACED) for batch in batches for i in range(0, batch.num_rows, PLACED)):
        n, rest, part = (b.column(c).to_numpy() for c in ("n", "rest", "part"))
        ids = [np.frombuffer(x, "<u2").astype("<u4") for x in b.column("ids").to_pylist()]
        whole = n // window
        row = np.repeat(np.arange(len(n)), whole)
        along = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        found = [(row, along * window, np.full(len(row), window), WHOLE * (part[row].astype(np.int64) + 1) + b.column("whole_before").to_numpy()[row] + along, np.zeros(len(row), np.int64))]
        some = np.flatnonzero(rest)
        number = b.column("number").to_numpy()[some] + b.column("base").to_numpy()[some]
        at = (n - rest)[some]
        for member, tokens, sequence, offset in plan.pieces(rest[some], number):
            found.append((some[member], at[member], tokens, sequence, offset))
            at[member] += tokens
        row, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found))
        cut = [ids[r][a : a + k] for r, a, k in zip(row.tolist(), start.tolist(), length.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(offset),
                pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())) if with_ids else pa.nulls(len(cut), pa.list_(pa.int32())),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (null unless ``with_ids``) of each piece."""
    schema = "part int, doc_id long, n long, rest long, number long, whole_before long, ids binary"
    rows = materialize(docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, vocabulary, window), schema))
    counts = materialize(rows.groupBy("part", "rest").count())
    histogram = np.zeros(window, np.int64)
    for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("count").alias("n")).collect():
        histogram[r.rest] = r.n
    plan = Plan(np.append(histogram, 0), window)
    base = F.sum("count").over(Window.partitionBy("rest").orderBy("part")) - F.col("count")
    bases = materialize(counts.select("part", "rest", base.alias("base")))
    placed = sized_join(rows, bases, ["part", "rest"], "inner")
    return placed.mapInArrow(
        lambda batches: _placed(batches, plan, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence of ``packed`` (with ids), at most a window long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packing_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    return packed(docs, vocabulary, with_ids=False).drop("ids")
