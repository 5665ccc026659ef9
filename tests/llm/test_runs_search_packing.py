"""Periodic runs, ranked search and packing against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lexical, packing, registry, runs

from .conftest import SF, edge_rows

BPE = public_tokenizers.path("byte_bpe_50k.json")


# 11


def brute_runs(ws, least=runs.LEAST):
    """Stretches of equal words q apart, for every q; of several periods of one stretch the smallest."""
    n, found = len(ws), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((i, z - i, q) for (i, z), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_against_all_periods():
    rng = random.Random(3)
    texts = [fibonacci(400), list("ab" * 9 + "a" + "ab" * 9), list("a" * 200), list(("ab" * 20 + "a") * 5), list("abcdef" * 2), list("abcdef" * 2 + "a"), [], ["x"], list("aab" * 4)]
    for _ in range(500):
        ws = [rng.choice("abcdefghijklmnopqrst"[: rng.choice([1, 2, 2, 3, 5, 20])]) for _ in range(rng.randint(0, 160))]
        for _ in range(rng.randint(0, 4) if ws else 0):
            a = rng.randrange(len(ws))
            p = 1 + rng.randrange(max(1, (len(ws) - a) // 2))
            for i in range(a, min(len(ws), a + rng.randint(2, 5) * p)):
                ws[i] = ws[a + (i - a) % p]
        texts.append(ws)
    found, collapsed = runs.runs_of_texts([" ".join(ws).encode() for ws in texts])
    for ws, got, kept in zip(texts, found, collapsed):
        assert got == brute_runs(ws)
        gone = {i for s, n, q in got for i in range(s + q, s + n)}
        assert kept.decode() == " ".join(w for i, w in enumerate(ws) if i not in gone)
    assert sum(map(len, found)) > 500


def test_runs_do_not_depend_on_the_block():
    texts = [" ".join(fibonacci(n)).encode() for n in (30, 77, 200)]
    assert runs.runs_of_texts(texts)[0] == [runs.runs_of_texts([t])[0][0] for t in texts]


def test_runs_of_long_texts_take_little_time():
    began = time.process_time()
    for ws in (["x"] * 200_000, [f"w{i % 997}" for i in range(200_000)], fibonacci(100_000)):
        assert runs.runs_of_texts([" ".join(ws).encode()])[0][0]
    assert time.process_time() - began < 30
    with pytest.raises(ValueError):
        runs.runs_of(np.arange(4), least=5)


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    w = runs.Wavelet(values)
    low, x = rng.integers(0, 300, 500), rng.integers(0, 301, 500)
    high = low + rng.integers(0, 301 - low)
    below = [int((values[a:z] < v).sum()) for a, z, v in zip(low, high, x)]
    assert w.below(low, high, x).tolist() == below
    some = np.flatnonzero(np.array(below) < high - low)
    assert w.ranked(low[some], high[some], np.array(below)[some]).tolist() == [min(values[a:z][values[a:z] >= v]) for a, z, v in zip(low[some], high[some], x[some])]


def changed(doc_id, ws):
    """The words of the query's text, one by one."""
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]


def test_run_digests(documents):
    short = documents.filter("length(text) < 3000")
    got = {r.doc_id: r for r in runs.run_digests(short).collect()}
    rows = short.collect()
    assert len(got) == len(rows) and any(r.n_runs for r in got.values())
    for d in rows:
        ws = changed(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        want, r = brute_runs(ws), got[d.doc_id]
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()


def test_run_edges(edge, empty):
    got = runs.run_digests(edge).collect()
    assert len(got) == len(edge_rows()) and runs.run_digests(empty).collect() == []
    none = hashlib.sha256(b"").hexdigest()
    assert {(r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) for r in got if r.doc_id in (1, 2, 3)} == {(0, None, none, none)}
    assert sorted(runs.periodic_runs(edge).select("doc.*").columns) == sorted(c for c in edge.columns if c != "text")


# 12


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    there = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms, df = len(there), sum(x[2] for x in there), Counter(t for _, c, _ in there for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in there:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words_of(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search_against_all_scores(spark):
    rng = random.Random(8)
    terms = [f"t{i}" for i in range(60)] + ["É", "Ünit", "数"]
    text = lambda n: " ".join(rng.choice(terms[: rng.choice([5, 20, 63])]) + rng.choice(["", ",", "-x", "."]) for _ in range(n))
    docs = [(i, rng.choice([None, "", " .,", *(text(rng.randint(1, 60)) for _ in range(12))])) for i in range(400)]
    docs += [(None, docs[7][1]), (7, docs[7][1]), (7, docs[7][1])] + [(1000 + i, "t1 t2 t3") for i in range(90)]
    items = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(30, None), (31, ""), (32, "absent"), (None, "T1 É"), (5, "t2 t3")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("z") for c in ("n", "terms", "no", "score", "rank")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("no", F.lit("z"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(brute_search(docs, items, 50), key=key)
    for block in (lexical.BLOCK_TERMS, 40):
        assert sorted(map(tuple, lexical.ranked_search(d, q, block_terms=block).collect()), key=key) == want
    assert lexical.ranked_search(d.limit(0), q).collect() == [] and lexical.ranked_search(d, q.limit(0)).collect() == []


def test_accumulators_are_limited():
    """Rare terms first: where they decide, documents that hold frequent terms alone get no accumulator; scores stay exact."""
    rng = np.random.default_rng(2)
    n = 5000
    lists = {1: (np.arange(0, n, 50), np.full(100, 900)), 2: (np.arange(0, n, 49), np.full(103, 800))}
    for t in range(3, 9):
        at = np.flatnonzero(rng.random(n) < 0.6)
        lists[t] = (at, rng.integers(1, 60, len(at)))
    total = np.zeros(n, np.int64)
    for at, c in lists.values():
        total[at] += c
    best = lexical.Best(50)
    created = lexical.search_block(lists, list(range(1, 9)), np.arange(n), best)
    want = sorted(zip((-total).tolist(), range(n)))[:50]
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want
    assert created < 300 < np.count_nonzero(total)


# 13


def check_pieces(rows, texts, window=packing.WINDOW):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    ids = {d: [e + [0] for e in ([] if not t else [x.ids for x in library.encode_batch(t, add_special_tokens=False)])] for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, (want,) in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    short = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        if at < window:
            short.append(at)
    return short


def test_packing_holds_each_id_once(spark, documents):
    texts = {r.doc_id: [r.text or ""] for r in documents.collect()}
    short = check_pieces(registry.op13_packing(spark, SF).collect(), texts)
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 10


def test_packed_sequences_decode(spark):
    from tokenizers import Tokenizer

    texts = {i: " ".join(f"w{i}x{j}" for j in range(3 + 17 * i)) for i in range(40)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = packing.packed(d, BPE, window=64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    assert max(map(len, whole.values())) == 64
    library = Tokenizer.from_file(BPE)
    for i, rows in {i: pieces.filter(F.col("doc_id") == i).orderBy("start").collect() for i in (0, 3, 39)}.items():
        assert library.decode([t for r in rows for t in whole[r.sequence_id][r.offset : r.offset + r.length]][:-1]) == texts[i]


@pytest.mark.parametrize("lengths", [[5], [700] * 500, [1023, 1], [512, 512], [341, 341, 342] * 9, list(range(1, 1024)), [401] * 900 + list(range(1, 1024)) * 2, [3] * 5000], ids=range(8))
def test_plan_fills_windows(lengths):
    h = np.bincount(lengths, minlength=1025)
    plan = packing.Plan(h)
    number = np.concatenate([np.arange(c) for c in h])
    fill, of = {}, np.zeros(len(lengths), np.int64)
    placed = []
    for member, tokens, sequence, offset in plan.pieces(np.repeat(np.arange(len(h)), h), number):
        of[member] += tokens
        placed += zip(sequence.tolist(), offset.tolist(), tokens.tolist())
    assert of.tolist() == sorted(lengths)
    for s, o, n in sorted(placed):
        assert fill.get(s, 0) == o
        fill[s] = o + n
    assert len(fill) == plan.n_sequences and all(n == 1024 or n < 1024 and n & (n - 1) == 0 for n in fill.values())
    assert sum(n < 1024 for n in fill.values()) <= 10


def test_repeat_counts_solve_what_can_be_filled():
    """A histogram made of full windows is solved with almost nothing left; depth is three at most."""
    rng = np.random.default_rng(4)
    h = np.zeros(1025, np.int64)
    for a, b in rng.integers(1, 511, (400, 2)).tolist():
        h[[a, b]] += 7 if a != b else 0
        h[1024 - a - b] += 7 if a != b else 0
    columns = packing.combinations(np.flatnonzero(h), 1024)
    assert (columns.sum(axis=1) == 1024).all() and len(columns) == len({tuple(c) for c in columns.tolist()})
    x = packing.repeat_counts(columns, h)
    made = np.bincount(columns.ravel(), weights=np.repeat(x, 3), minlength=1025)
    made[0] = 0
    assert (x >= 0).all() and np.abs(made - h).sum() < 0.02 * h.sum()
    plan = packing.Plan(h)
    assert plan.n_cut < 0.1 * h.sum()


def test_packing_edges(edge, empty):
    rows = packing.packed(edge, BPE, with_ids=False).collect()
    assert packing.packing_digests(empty, BPE).collect() == []
    key = lambda x: (x is not None, x or 0)
    first = sorted((r.doc_id for r in rows if r.start == 0), key=key)
    assert first == sorted((r[0] for r in edge_rows()), key=key)
    assert [r.doc_tokens for r in rows if r.doc_id == 1] == [1] and sum(r.length for r in rows if r.doc_id == 7) == next(r.doc_tokens for r in rows if r.doc_id == 7)
