import numpy as np
import pytest

from tidewatch.operators import vector_index
from tidewatch.sources.scratch import new_path


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.25 * rng.normal(size=(3000, 16))).round(4)
    x[10] = x[11] = x[12]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [float("inf")] + [1.0] * 15)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def index(spark, clustered):
    return vector_index.write_index(clustered[1], new_path(spark), lists=40)


def brute(x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u[q] + 1e-9, 6)
    return sorted((-c, i) for i, c in enumerate(cos.tolist()) if i != q)[:k]


def test_exact_and_few_lists(clustered, index):
    x, rows = clustered
    queries = rows.filter("vec_id % 60 = 0 or vec_id in (10, 11) or vec_id >= 5000")
    got = {}
    for r in vector_index.search(index, queries, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.cosine)
    assert sorted(got) == sorted({10, 11, *range(0, 3000, 60)})
    for q, found in got.items():
        for rank, (c, i) in enumerate(brute(x, q, 5), 1):
            assert found[rank][1] == pytest.approx(-c, abs=2e-6)
    assert [got[10][r][0] for r in (1, 2)] == [11, 12]


def test_bounds_spare_most_vectors(clustered, index):
    _, rows = clustered
    q = vector_index.units(rows.filter("vec_id % 60 = 0")).withColumnsRenamed({"vec_id": "query_id", "unit": "q"})
    b = vector_index.bounds(index, q).cache()
    least = {r.query_id: r.cosine for r in vector_index.search(index, rows.filter("vec_id % 60 = 0"), 5).filter("rank = 5").collect()}
    opened = sum(r.n for r in b.collect() if r.bound >= least[r.query_id] - 2e-6)
    assert opened < 0.4 * 3000 * len(least)
    assert index.lists.agg({"n": "sum"}).first()[0] == 3000  # every vector with a direction


def test_recall_of_probes(clustered, index):
    x, rows = clustered
    got = {}
    for r in vector_index.search(index, rows.filter("vec_id % 60 = 0"), 5, probes=6).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len({i for _, i in brute(x, q, 5)} & found) for q, found in got.items())
    assert hits / (5 * len(got)) >= 0.9


def test_few_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in vector_index.nearest(rows, rows.filter("vec_id = 0")).collect()] == [(0, 1)]
    assert vector_index.nearest(rows.limit(1), rows.limit(1)).collect() == [] and vector_index.nearest(rows.limit(0), rows).collect() == []


def test_blocks_of_lists_and_queries(clustered, index, monkeypatch):
    """Lists and queries dealt into small blocks give the same rows."""
    queries = clustered[1].filter("vec_id % 90 = 0")
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    whole = key(vector_index.search(index, queries, 5))
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    assert key(vector_index.search(index, queries, 5)) == whole and len(whole) == 5 * 34


def test_a_block_keeps_the_smallest_ids_of_copies():
    import pyarrow as pa

    unit = [[1.0, 0.0]] * 50 + [[0.0, 1.0]]
    v = pa.table({"vec_id": pa.array(range(51)), "unit": pa.array(unit)})
    found = vector_index._block_nearest(v, pa.table({"query_id": pa.array([0]), "q": pa.array([[1.0, 0.0]])}), 3)
    assert found.column("vec_id").to_pylist() == [1, 2, 3] and found.column("dot").to_pylist() == [1.0] * 3
    assert vector_index._block_nearest(v, pa.table({"query_id": pa.array([], "int64"), "q": pa.array([], pa.list_(pa.float64()))}), 3).num_rows == 0
