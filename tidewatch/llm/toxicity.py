"""Toxicity of restored text.

Noisy channel: what is written in leetspeak, with separators inside a word, in fragments of one or two characters with
spaces between, or with letters repeated, opens a lattice of characters; an exact Viterbi search under a character
language model picks the reading. A word whose lattice has a single path (letters only, no two alike in a row) stays as
it is, and so do numbers; readings are kept per distinct written word, in a bounded table.

The language model (4-grams over 28 classes: letters without accents, other letters, word ends) is counted over every
document; its table has 28**4 cells whatever the corpus, which bounds what is gathered. The classifier, a logistic
regression over the presence of restored words and their stems, is fitted on at most ``TRAIN_DOCS`` labelled documents (a documented
bound: those with the smallest xxhash64 of doc_id) that are not held out, on the ``WORDS`` features that tell the labels
apart best by their chi-square.

Nulls and odd input: null and empty texts have no words and get the score of the intercept; without labels of both
classes every score is the share of toxic labels (0 without any); labels that are null or without a doc_id teach nothing,
of several for one doc_id the largest holds; repeated rows each get a row; an empty table gives an empty result. Extra
columns are ignored. Very long words are decoded whole, in time in proportion to their length.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize
from tidewatch.llm.langid import remainder

TRAIN_DOCS = 20_000
WORDS = 400
MIN_DOCS = 3
#: A stem of so many leading letters of a word is a feature beside the word itself.
STEMS = (4, 5, 6)
CACHE_WORDS = 500_000
PIECE = 1 << 20

CLASSES = 28
END, OTHER = 0, 27
#: What a written character may stand for besides itself or nothing.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz",
}
SEPARATORS = set("._-*~^'`´·,:;/\\#%&=<>()[]{}\"?")
COST_LEET, COST_DROP, COST_DROP_DIGIT, COST_BREAK, COST_RUN, COST_PAIR, COST_WILD, COST_JOIN = -0.5, -1.0, -7.3, -3.0, -0.3, -3.0, -3.5, -1.0
#: Signs that may be letters at a word's start; at its end most are punctuation.
SIGNS = "@$!|+(*"
#: A longer run of wildcards is decoration, as letters in their place would be anybody's guess.
WILD_RUN = 3
_NUMBER = re.compile(r"[+$(|]*[0-9][0-9.,:;/()%+*-]*")

_FOLD = np.arange(0x110000, dtype=np.uint32)
_CLASS = np.zeros(0x110000, np.uint8)


def _tables() -> None:
    if _CLASS[ord("a")]:
        return
    for i in range(0x110000):
        c = chr(i)
        if not c.isalpha():
            continue
        base = unicodedata.normalize("NFKD", c.lower())[0]
        _FOLD[i] = ord(base)
        _CLASS[i] = ord(base) - 96 if "a" <= base <= "z" else OTHER


def fold(word: str) -> str:
    if word.isascii():
        return word.lower()
    _tables()
    return "".join(chr(_FOLD[ord(c)]) for c in word)


def count_ngrams(texts: list[str | None]) -> np.ndarray:
    """4-gram counts of the classes of all characters; each run of other characters is one word end."""
    _tables()
    out, codes = np.zeros(CLASSES**4, np.int64), []
    for t in texts:
        for start in range(0, len(t or ""), PIECE):
            x = _CLASS[np.frombuffer(t[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
            x = np.concatenate(([0], x, [0]))
            x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
            x = np.concatenate(([0, 0], x))
            codes.append(((x[:-3] * CLASSES + x[1:-2]) * CLASSES + x[2:-1]) * CLASSES + x[3:])
            if sum(map(len, codes)) > PIECE:
                out += np.bincount(np.concatenate(codes), minlength=len(out))
                codes = []
    if codes:
        out += np.bincount(np.concatenate(codes), minlength=len(out))
    return out


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of each class after each three, counted over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**4, np.int64)
        for b in batches:
            total += count_ngrams(b.column("text").to_pylist())
        at = np.flatnonzero(total)
        for k in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 10_000], pa.int64()), pa.array(total[at[k : k + 10_000]], pa.int64())], names=["gram", "n"])

    sums = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**4)
    counts[sums["gram"].to_numpy(np.int64)] = sums["n"].to_numpy()
    c4 = counts.reshape((CLASSES,) * 4)
    p = np.full(CLASSES, 1 / CLASSES)
    for c in (c4.sum((0, 1, 2)), c4.sum((0, 1)), c4.sum(0), c4):  # each order leans on the one below
        p = (c + 4 * p) / (c.sum(-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32)


Place = list[tuple[tuple[int, ...], str, float]]


def _emit(text: str, cost: float) -> tuple[tuple[int, ...], str, float]:
    """The classes of ``text``, the text, and its channel score."""
    return tuple(0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else OTHER for c in text), text, cost


class Restorer:
    def __init__(self, model: np.ndarray):
        self.flat: list[float] = model.ravel().tolist()
        self.cache: dict[str, tuple[str, ...]] = {}
        self.known: dict[tuple[str, int], list[Place]] = {}

    @staticmethod
    def noisy(core: str) -> bool:
        """Whether the lattice of ``core`` has more than one path."""
        if core.isalpha():
            return any(a == b for a, b in zip(core, core[1:]))
        return not _NUMBER.fullmatch(core) and sum(c.isalpha() or c in LEET for c in core) >= 2

    @staticmethod
    def core(word: str) -> str:
        """``word`` without edge characters that cannot be part of it: at its start all but letters, digits and leet
        signs, at its end also the signs that are punctuation there."""
        if word.isalpha():
            return word
        low, high = 0, len(word)
        while low < high and not (word[low].isalnum() or word[low] in SIGNS):
            low += 1
        while high > low and not (word[high - 1].isalnum() or word[high - 1] in "@$"):
            high -= 1
        return word[low:high]

    def words(self, written: str) -> tuple[str, ...]:
        """The words that a written word reads as."""
        found = self.cache.get(written)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            core = self.core(fold(written))
            found = tuple(self.decode(self.places(core)).split()) if self.noisy(core) else (core,) if core else ()
            self.cache[written] = found
        return found

    def _run(self, c: str, n: int) -> list[Place]:
        """The places of a run of ``n`` times ``c``. Letters, separators and decoration are one place; each leet sign is
        its own, where one like the sign before may be its repetition."""
        if c.isalpha():
            return [[_emit(c, 0.0)] if n == 1 else [_emit(c, COST_PAIR), _emit(c * 2, 0.0)] if n == 2 else [_emit(c, COST_RUN), _emit(c * 2, COST_RUN)]]
        letters = "" if c == "*" and n > WILD_RUN else LEET.get(c, "")
        cost = COST_WILD if c == "*" else COST_LEET
        drop = COST_DROP if c in SEPARATORS or not c.isdigit() else COST_DROP_DIGIT
        apart = min(COST_BREAK, drop)  # what a word end replaces is dropped too
        first = [_emit(" ", apart), _emit("", drop), *[_emit(x, cost) for x in letters]]
        return [first] + [[_emit(" ", apart), _emit("", COST_RUN), *[_emit(x, cost) for x in letters]]] * (n - 1 if letters else 0)

    def places(self, core: str) -> list[Place]:
        out, i, known = [], 0, self.known
        while i < len(core):
            c, n = core[i], 1
            while i + n < len(core) and core[i + n] == c:
                n += 1
            i += n
            key = c, n if n <= 3 or (c in LEET and c != "*") else 4
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = self._run(*key)
            out += known[key]
        return out

    def decode(self, places: list[Place]) -> str:
        """The best reading: Viterbi over states of the last three classes, all of them kept."""
        flat, size = self.flat, CLASSES**3
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for place in [*places, [_emit(" ", 0.0)]]:
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, path) in states.items():
                for codes, text, cost in place:
                    s, at = score + cost, state
                    for k in codes:
                        if k or at % CLASSES:  # one word end is enough
                            at = at * CLASSES + k
                            s += flat[at]
                            at %= size
                    old = new.get(at)
                    if old is None or old[0] < s:
                        new[at] = s, (path, text)
            states = new
        path, parts = max(states.values(), key=lambda x: x[0])[1], []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def spelled(self, written: list[str]) -> tuple[list[str], list[str]]:
        """Readings of runs of three or more fragments: of single characters, joined; of one or two characters, the words
        that the search joins."""
        apart, joined, run = [], [], []
        for w in [*written, "   "]:
            if len(w) <= 2:
                run.append(w)
                continue
            if len(run) >= 3:
                cores = [self.core(fold(x)) for x in run]
                if all(len(x) == 1 for x in run):
                    if any(cores):
                        apart.append(self.decode(self.places(self.core(fold("".join(run))))).replace(" ", ""))
                elif not all(c.isdigit() or not c for c in cores):
                    join = [_emit(" ", 0.0), _emit("", COST_JOIN)]
                    places = [p for c in cores if c for p in (join, *self.places(c))][1:]
                    joined += [x for x in self.decode(places).split() if x not in cores]
            run = []
        return apart, joined

    def distinct(self, text: str | None) -> set[str]:
        """Features of ``text``: its restored words and their stems (leading letters, marked by *)."""
        written = text.split() if text else []
        found = {f for w in set(written) for r in self.words(w) for f in features(r)}
        return found.union(*[features(s) for some in self.spelled(written) for s in some])


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


class Finder:
    """The features of a lexicon that texts have."""

    def __init__(self, model: np.ndarray, index: dict[str, int]):
        self.restorer, self.index, self.cache = Restorer(model), index, {}

    def word(self, written: str) -> tuple[int, ...]:
        found = self.cache.get(written)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.restorer.cache.clear()
            found = self.cache[written] = tuple({self.index[f] for r in self.restorer.words(written) for f in features(r) if f in self.index})
        return found

    def __call__(self, text: str | None) -> list[int]:
        """Sorted numbers of features; of letters spelled apart, those that occur inside the reading."""
        written = text.split() if text else []
        found = set()
        for w in set(written):
            found.update(self.word(w))
        apart, joined = self.restorer.spelled(written)
        for s in apart:
            found.update([i for f, i in self.index.items() if len(f) > 4 and f.rstrip("*") in s])
        found.update([self.index[f] for s in joined for f in features(s) if f in self.index])
        return sorted(found)


_FINDERS: dict[str, Finder] = {}


def finder(name: str, model: np.ndarray, index: dict[str, int]) -> Finder:
    """The one of this name: one for each worker process, so its tables outlive a task."""
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = Finder(model, index)
    return _FINDERS[name]


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """text and toxic of the labelled documents to learn from; materialised."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.filter(remainder("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(materialize(y)), "doc_id").select("text", F.col("toxic").cast("double").alias("toxic")))


def lexicon(rows: DataFrame, model: np.ndarray, words: int = WORDS, min_docs: int = MIN_DOCS) -> list[str]:
    """The restored words whose presence tells the labels apart best and speaks for toxicity."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model)
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for w in r.distinct(text):
                    seen.setdefault(w, [0, 0])[toxic >= 0.5] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["word", "pos", "neg"])

    totals = rows.agg(F.sum((F.col("toxic") >= 0.5).cast("long")), F.sum((F.col("toxic") < 0.5).cast("long"))).first()
    p, n = (totals[0] or 0), (totals[1] or 0)
    if not p or not n:
        return []
    sums = rows.mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg, total = F.col("pos"), F.col("neg"), p + n
    ad_bc = pos * n - neg * p
    chi = (total * ad_bc.cast("double") * ad_bc) / ((pos + neg).cast("double") * (total - pos - neg + 1) * p * n)
    best = sums.filter((pos >= min_docs) & (ad_bc > 0)).orderBy(chi.desc(), "word").limit(words)
    return [r.word for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, int], np.ndarray, float]:
    """The language model, the lexicon, its weights and the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    model = language_model(docs)
    rows = training_rows(docs, labels)
    words = lexicon(rows, model)
    index = {w: i for i, w in enumerate(words)}
    if not words:
        share = rows.agg(F.avg("toxic")).first()[0] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return model, {}, np.zeros(0), math.log(share / (1 - share))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model, index)
        for b in batches:
            x = np.zeros((b.num_rows, len(index)))
            for i, text in enumerate(b.column("text").to_pylist()):
                x[i, find(text)] = 1
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    data = materialize(rows.mapInArrow(present, "x array<double>, toxic double")).select(array_to_vector("x").alias("features"), "toxic")
    found = LogisticRegression(labelCol="toxic", regParam=0.0001, elasticNetParam=0.5, standardization=False, maxIter=60).fit(data)
    return model, index, np.array(found.coefficients.toArray()), float(found.intercept)


def scores(docs: DataFrame, fitted: tuple[np.ndarray, dict[str, int], np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    (model, index, weights, intercept), name = fitted, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(name, model, index)
        for b in batches:
            z = [intercept + weights[find(t)].sum() for t in b.column("text").to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))
