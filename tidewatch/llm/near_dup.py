"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of hashed five-word shingles, a MinHash signature of which the low ``BITS`` bits of each
   minimum are kept and packed, and band keys over the full minima. Documents of equal sets form a class; only one row
   per class goes on, so copies cost nothing further.
2. Classes that share a band key are candidates. Buckets with the same members in several bands are taken once. A bucket
   is cut into blocks bounded by members and by shingles, and each pair of blocks is a task's unit of work, so no group
   is ever held whole.
3. Within a pair of blocks, similarity is estimated from the packed signatures by bit counts, corrected for chance
   agreement of b bits. Pairs that may reach the threshold are confirmed on their full sets. A unit returns links that
   connect what it found connected, never all pairs.
4. Links are contracted to components by joins; the smallest doc_id names a component.

Every pair that shares a bucket is compared, so the only pairs that can be missed are those that share no band: at a
similarity of 0.85 with 24 bands of 5 minima fewer than one in a million, at 0.8 about 7 in 100,000. The estimate rejects a pair only when it lies
``SLACK`` (six standard deviations) under the threshold.

Nulls and odd input: null texts and texts without words have empty sets, link with nothing and are their own component;
a null doc_id joins its class but never names it, unless all of the component's are null (then component_id and kept are null);
rows of equal doc_id are separate rows of one table and link by their own texts; an empty table gives an empty result.
Extra columns are ignored by ``near_duplicates`` and kept by ``deduplicated`` under any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import WORD, materialize

SHINGLE = 5
BANDS, ROWS = 24, 5
BITS = 4
SLACK = 0.22
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 500_000
PERCENT = 85
#: For taking near-duplicates out of a corpus.
CORPUS_PERCENT = 80

_WORDS = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.uint64((1 << 48) - 1)


class _Hashes(dict):
    """64-bit hash of each word, kept while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the text's shingles."""
    words = _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _M + h[i : n - k + 1 + i]
    return np.unique(_mix(out) & _KEEP)


def _multipliers() -> np.ndarray:
    return _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _M) | np.uint64(1)


_A = _multipliers()[:, None]


def minima(s: np.ndarray) -> np.ndarray:
    """One minimum for each permutation."""
    x, out = s * _M, None
    for i in range(0, len(x), 2048):
        m = (_A * x[i : i + 2048]).min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out


def packed(m: np.ndarray) -> bytes:
    """The low BITS bits of each minimum, two minima to a byte."""
    low = (_mix(m) & np.uint64(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def band_keys(m: np.ndarray) -> list[int]:
    key = np.zeros(BANDS, np.uint64)
    for column in m.reshape(BANDS, ROWS).T:
        key = key * _M + column
    return _mix(key).view(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each signature in ``a`` with each in ``b`` (rows of packed bytes), corrected for agreement by chance."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        x = b ^ row
        x |= x >> 1
        x |= (x >> 2) & 0x33  # the low bit of each half says whether the half differs
        differ = np.bitwise_count(x & 0x11).sum(axis=1)
        out[i] = 1 - differ / (BANDS * ROWS)
    chance = 1 / (1 << BITS)
    return (out - chance) / (1 - chance)


_SIGNED = "n_shingles long, set_key binary, signature binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, keys, signatures, bands = [], [], [], []
        for text in b.column("__text").to_pylist():
            s = shingles(text)
            n.append(len(s))
            if len(s):
                m = minima(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                signatures.append(packed(m))
                bands.append(band_keys(m))
            else:
                keys.append(None), signatures.append(None), bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc", "text_key", "n_shingles", "set_key", "signature", "bands"],
        )


def signed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``doc`` (the ``keep`` columns) with a hash of the text, set size, set key, signature and bands, and a row id; materialised."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.xxhash64("text").alias("text_key"), F.col("text").alias("__text"))
    schema = T.StructType([d.schema["doc"], d.schema["text_key"], *T.StructType.fromDDL(_SIGNED).fields])
    return materialize(d.mapInArrow(_sign, schema).withColumn("rid", F.monotonically_increasing_id()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, keys, sets = [], [], []
        for node, key, text in zip(b.column("node").to_pylist(), b.column("set_key").to_pylist(), b.column("text").to_pylist()):
            s = shingles(text)
            if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key:  # else another text of this doc_id and hash
                nodes.append(node)
                sets.append(s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by products of incidence matrices over slices of the shared shingles."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    use = shared[column]
    rows, column = rows[use], rank[column[use]]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 8192
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for low in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(column, [low, low + width])
        x = np.zeros((len(sets), width), np.float32)
        x[rows[a:z], column[a:z] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def links(nodes: list[int], signatures: np.ndarray, raw: list[bytes], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``nodes``. Where ``left`` marks some but not all of them (a unit of two
    different blocks), only pairs across the mark are compared."""
    n = len(nodes)
    may = np.triu(estimate(signatures, signatures) >= percent / 100 - SLACK, 1)
    if left.any() and not left.all():
        may &= left[:, None] != left[None, :]
    pairs = np.argwhere(may)
    if not len(pairs):
        return []
    used = np.unique(pairs)
    sets = {int(i): _unpack(raw[i]) for i in used}
    if len(pairs) <= 4 * len(used):
        common = {(i, j): len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()}
    else:
        at = {int(i): k for k, i in enumerate(used)}
        table = _common([sets[int(i)] for i in used])
        common = {(i, j): int(table[at[i], at[j]]) for i, j in pairs.tolist()}
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for (i, j), c in common.items():
        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return out


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit (bucket and pair of blocks); a unit may run over several batches."""
        unit, rows, found = None, [], set()

        def done() -> None:
            members = {r[0]: r for r in rows}.values()
            if len(members) > 1:
                nodes, signatures, raw, left = map(list, zip(*members))
                found.update(links(nodes, np.frombuffer(b"".join(signatures), np.uint8).reshape(len(nodes), -1), raw, np.array(left), percent))

        def out() -> pa.RecordBatch:
            pairs = list(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("band", "key", "bi", "bj", "node", "signature", "shingles", "left")]
            for band, key, bi, bj, *row in zip(*columns):
                if (band, key, bi, bj) != unit:
                    done()
                    unit, rows = (band, key, bi, bj), []
                rows.append(row)
            if len(found) > 10_000:
                yield out()
        done()
        yield out()

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node in ``edges`` (a > b; materialised).

    Each round hooks every node to its smallest neighbour below it, follows hooks to their ends by doubling and
    contracts the edges; hot nodes only ever meet partial minima and equi-joins.
    """
    roots = None
    while True:
        parent = edges.groupBy("a").agg(F.min("b").alias("p"))
        every = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        step = materialize(every.join(parent, F.col("node") == F.col("a"), "left").select("node", F.coalesce("p", "node").alias("root")))
        while True:
            up = step.select(F.col("node").alias("n"), F.col("root").alias("r"))
            further = materialize(step.join(up, F.col("root") == F.col("n")).select("node", F.col("r").alias("root"), (F.col("r") != F.col("root")).alias("moved")))
            step, moved = further.drop("moved"), further.filter("moved").limit(1).count()
            if not moved:
                break
        s = step.withColumnsRenamed({"node": "n", "root": "r"})
        if roots is None:
            roots = step
        else:
            roots = materialize(roots.join(s, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root")))
        e = edges.join(s, F.col("a") == F.col("n")).select(F.col("r").alias("a"), "b").join(s, F.col("b") == F.col("n")).select("a", F.col("r").alias("b"))
        edges = materialize(e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if not edges.limit(1).count():
            return roots


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set, with a node number; materialised."""
    c = rows.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("rep"), "text_key")).alias("r"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    return materialize(c.select("set_key", "r.rep", "r.text_key", "n", "signature", "bands").withColumn("node", F.monotonically_increasing_id()))


def class_links(groups: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between nodes of ``groups``; ``texts`` has doc_id and text of each group's representative."""
    banded = groups.select("node", "n", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(
        F.count("*").alias("size"), F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("f1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("f2")).filter("size > 1")
    once = buckets.groupBy("f1", "f2", "size", "total").agg(F.min(F.struct("band", "key")).alias("k")).select("k.band", "k.key", "size", "total")
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    once = materialize(once.select("band", "key", n_blocks.alias("blocks")))
    members = materialize(banded.join(once, ["band", "key"]).select("band", "key", "blocks", "node"))
    need = members.select("node").distinct().join(groups.select("node", "set_key", "rep", "text_key", "signature"), "node")
    mine = texts.select("doc_id", "text", F.xxhash64("text").alias("k"))
    sets = mine.join(need.select("node", "set_key", "rep", "text_key"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("k") == F.col("text_key"))).select("node", "set_key", "text")
    sets = sets.mapInArrow(_sets, "node long, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("band", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "node", (F.col("own") <= F.col("other")).alias("left"))
    rows = units.join(need.select("node", "signature").join(sets, "node"), "node")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "band", "key", "bi", "bj").sortWithinPartitions("band", "key", "bi", "bj", "node")
    return materialize(rows.mapInArrow(_compare(percent), "a long, b long").distinct())


def grouped(rows: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rows`` (of ``signed``) with group (one of its nodes; null without words) and component_id."""
    groups = classes(rows)
    edges = class_links(groups, texts, percent)
    named = groups.select("node", "set_key", "rep")
    if edges.limit(1).count():
        roots = components(edges)
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = materialize(named.join(least, "root").select("set_key", F.col("root").alias("group"), "component_id"))
    else:
        named = named.select("set_key", F.col("node").alias("group"), F.col("rep").alias("component_id"))
    empty = rows.filter("n_shingles = 0").withColumn("group", F.lit(None).cast("long")).withColumn("component_id", F.col("doc.doc_id"))
    return rows.filter("n_shingles > 0").join(named, "set_key").select(*rows.columns, "group", "component_id").unionByName(empty)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document."""
    rows = signed(docs, ["doc_id"])
    g = grouped(rows, docs.select("doc_id", "text"), percent)
    return g.select("doc.doc_id", "n_shingles", "component_id", (F.col("doc.doc_id") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = CORPUS_PERCENT) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates (the smallest doc_id's), with the columns of ``docs``.

    Documents without words are all kept.
    """
    rows = signed(docs, docs.columns)
    g = grouped(rows, rows.select("doc.doc_id", "doc.text"), percent)
    keep = g.filter("n_shingles > 0").groupBy("group").agg(F.min_by("rid", F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", "rid")).alias("rid"))
    kept = rows.filter("n_shingles > 0").join(keep.select("rid"), "rid", "left_semi").unionByName(rows.filter("n_shingles = 0"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(list_slice(words, i, i + {SHINGLE - 1}), ' ') as sh
  from (select doc_id, words, unnest(range(1, greatest(len(words) - {SHINGLE - 2}, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
both_ways as (select a, b from link union all select b, a from link),
reach as (select doc_id, doc_id as seen from documents union select r.doc_id, b as seen from reach r join both_ways on a = seen)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(seen) as component_id, doc_id = min(seen) as kept
from reach left join n using (doc_id) group by doc_id"""
