"""Licence scans: passages of whole texts against licence templates by the Dice coefficient over word bigrams.

Words are runs of letters and digits in lower case. For a template of b distinct bigrams and a threshold t, a passage of a
distinct bigrams can only reach t if t/(2-t) * b <= a <= (2-t)/t * b, and if it holds at least t/(2-t) * b of the
template's bigrams. Templates whose bigrams are too few in a text are not looked at; for the others, occurrences of the
template's bigrams are cut into runs where more than 2(1-t)/t * b words lie between, as no passage of that Dice has such
a gap. In a run every occurrence starts a passage, whose end is the occurrence within the size bounds that gives the highest
coefficient, then the longest passage. Of all passages the one with the highest coefficient is taken (then the longer, then the
template's name, then the first), and those that it overlaps end earlier or go, so that notices that stand close together
are found one by one. Starts wait under an upper bound and are looked at only while they lie outside what is taken, so a text
that repeats a licence or a phrase over and over costs about as much as one of its length that doesn't.

The templates are a parameter, small and sent to every task. ``TEMPLATES`` has the texts of public licences (long ones as files), and
notices, headers and openings of these and of longer ones. Names are licence/part.

Nulls and odd input: null and empty texts have no passage; one-word texts have no bigram; repeated rows each get a row; an
empty table gives an empty result. Extra columns are ignored. Offsets are code points of the whole text.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.licence_texts import TEMPLATES

THRESHOLD = 0.8
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)] if not text.isascii() else _WORDS.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.t = threshold
        self.names = sorted(n for n, x in templates.items() if len(words_of(x)) > 1)
        self.sets = [bigrams(words_of(templates[n])) for n in self.names]
        vocabulary = sorted({w for s in self.sets for b in s for w in b})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.base = len(vocabulary) + 1
        pairs = sorted({self.number[a] * self.base + self.number[b] for s in self.sets for a, b in s})
        self.codes = np.array(pairs, np.int64)
        self.has = np.zeros((len(pairs), len(self.names)), bool)
        for k, s in enumerate(self.sets):
            self.has[np.searchsorted(self.codes, [self.number[a] * self.base + self.number[b] for a, b in s]), k] = True
        self.sizes = np.array([len(s) for s in self.sets])
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)
        self.gap = np.floor(self.sizes * 2 * (1 - threshold) / threshold + 1e-9).astype(int) + 1

    def dice(self, words: list[str], k: int) -> float:
        own = bigrams(words)
        return 2 * len(own & self.sets[k]) / (len(own) + len(self.sets[k]))

    def _ending(self, before: np.ndarray, own: np.ndarray, at: np.ndarray, s: int, k: int, limit: int) -> tuple[float, int] | None:
        """The best Dice of a passage from place ``s`` and its end, ``limit`` at most; None below the threshold. ``at`` has the
        places of the template's bigrams, which ``own`` marks.

        A bigram is new to the passage where it last stood before ``s``; Dice changes at such places alone. They are looked
        for until the passage is too large for the threshold, or for the best so far with all that is missing.
        """
        size, most = self.sizes[k], self.sizes[k] * (2 - self.t) / self.t + 1e-9
        z, width, new = s, 64 + 2 * int(most), np.zeros(0, np.int64)
        while True:
            far = min(s + width, limit - 1)
            new = np.concatenate((new, z + np.flatnonzero(before[z:far] < s)))
            z, width = far, 4 * width
            mine = np.flatnonzero(own[new[: int(most)]])
            hits = np.arange(1, len(mine) + 1)
            d = 2 * hits / (mine + 1 + size)
            best = d.max(initial=0)
            if z == limit - 1 or len(new) > most or 2 * size < best * (len(new) + 2 * size - len(mine)):
                break
        if best < self.t:
            return None
        last = int(mine[np.flatnonzero(d == best)[-1]])
        # equal Dice up to the next new place: the longest passage
        end = int(new[last + 1]) if last + 1 < len(new) else z
        while last + 1 == len(new) and end < limit - 1:
            more = np.flatnonzero(before[end : end + width] < s)
            end = min(end + (int(more[0]) if len(more) else width), limit - 1)
            if len(more):
                break
            width *= 4
        return float(best), int(at[np.searchsorted(at, end) - 1]) + 2

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, template, Dice) of the passages found, in order."""
        words = words_of(text) if text else []
        if len(words) < 2 or not self.names:
            return []
        n = np.fromiter(map(self.number.get, words, [0] * len(words)), np.int64, len(words))
        both = np.flatnonzero((n[:-1] > 0) & (n[1:] > 0))
        codes = n[both] * self.base + n[both + 1]
        where = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[where] == codes
        both, where = both[hit], where[hit]
        near = np.flatnonzero(self.has[np.unique(where)].sum(axis=0) >= self.least)
        if not len(near):
            return []
        ids: dict[str, int] = {}
        numbers = np.array([ids.setdefault(w, len(ids)) for w in words])
        pairs = numbers[:-1] * len(ids) + numbers[1:]
        order = np.argsort(pairs, kind="stable")
        before = np.full(len(pairs), -1)  # where a place's bigram stood last
        same = pairs[order[1:]] == pairs[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        has = {k: self.has[where, k] for k in near.tolist()}
        own = {k: np.zeros(len(pairs), bool) for k in has}
        # places wait under a bound of their Dice, by the template's bigrams that are left in their run, and are looked at only
        # when nothing better is left; those that a taken passage covers by then never are
        waiting: list[tuple[float, int, str, int, int, int]] = []
        places = {}
        for k, mine in has.items():
            at = places[k] = both[mine]
            own[k][at] = True
            other = np.where(own[k], len(pairs), np.arange(len(pairs)))
            other = np.minimum.accumulate(other[::-1])[::-1]  # the next bigram that is not the template's
            for run in np.split(at, np.flatnonzero(np.diff(at) > self.gap[k]) + 1):
                if len(run) >= self.least[k]:
                    last = np.ones(len(run), bool)
                    by = np.argsort(pairs[run], kind="stable")
                    last[by[:-1]] = pairs[run][by[1:]] != pairs[run][by[:-1]]
                    left = np.cumsum(last[::-1])[::-1]
                    some = left >= self.least[k]
                    run, left = run[some], left[some]
                    alone = np.minimum(other[run] - run, left)  # without any other bigram, or with one at least
                    bound = np.maximum(2 * alone / (alone + self.sizes[k]), 2 * left / (left + 1 + self.sizes[k]))
                    waiting += [(-b, -(1 << 60), self.names[k], p, -1, k) for p, b in zip(run.tolist(), bound.tolist())]
        heapq.heapify(waiting)
        taken: list[tuple[int, int, str, float]] = []
        while waiting:
            d, _, name, a, z, k = heapq.heappop(waiting)
            n_before = bisect.bisect_right(taken, a, key=lambda x: x[0])
            if n_before and taken[n_before - 1][1] > a:
                continue
            limit = taken[n_before][0] if n_before < len(taken) else len(words)
            if 0 <= z <= limit:
                taken.insert(n_before, (a, z, name, -d))
            elif limit - a > 1 and (r := self._ending(before, own[k], places[k], a, k, limit)):
                heapq.heappush(waiting, (-r[0], a - r[1], name, a, r[1], k))
        if taken:
            spans = [m.span() for m in _WORDS.finditer(text)]
            taken = [(spans[a][0], spans[z - 1][1], name, d) for a, z, name, d in taken]
        return taken


def passages(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and passages (array of start, end, template, dice); one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("template", pa.string()), ("dice", pa.float64())]))
        for b in batches:
            found = [[dict(zip(("start", "end", "template", "dice"), p)) for p in scanner.scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], names=["doc_id", "passages"])

    schema = "doc_id long, passages array<struct<start: long, end: long, template: string, dice: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def licence_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_passages, licences (start:end:template, comma-joined), best_template and best_dice; one row per document."""
    best = F.expr("array_max(transform(passages, p -> struct(p.dice, -p.start AS first, p.template)))")
    said = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"], p["end"], p["template"])), ",")
    return passages(docs, templates, threshold).select(
        "doc_id", F.size("passages").cast("long").alias("n_passages"), said.alias("licences"),
        best["template"].alias("best_template"), best["dice"].alias("best_dice"))
