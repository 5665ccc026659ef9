"""Nearest vectors by cosine from an inverted-file index, exact by bounds or approximate by a number of lists.

The index is written once: vectors of length one, partitioned by the list of their nearest centroid, and for each list its centroid,
its size and its radius (the widest angle between the centroid and a member). A query at angle a from a centroid can't be nearer than
a - radius to any member. So a query first opens the lists with the best bounds, until they hold ``FIRST * k`` vectors; its k-th cosine
there is its bar, and of the other lists only those whose bound reaches the bar are opened. Vectors are moved once, when they are
written; a search meets the blocks of each list with the queries that open it, and scores a block as a matrix product.

Centroids are fitted on at most ``SAMPLE`` vectors (by hash of their id); every vector is indexed. Vectors that are null, of
length zero or hold a null or no finite number have no cosine and take no part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6
from tidewatch.sources.scratch import materialize, new_path, shuffled

LISTS, SAMPLE, FIRST = 100, 20_000, 4
#: Vectors, and queries, of one group of a search at most (about; longer lists are dealt into blocks), and pairs scored at once.
BLOCK, PAIRS = 20_000, 2_000_000


class VectorIndex(NamedTuple):
    #: list, vec_id, unit
    vectors: DataFrame
    #: list, centroid, radius, n
    lists: DataFrame


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and unit (doubles) of the vectors that have a direction."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = vectors.select("vec_id", e.alias("e")).filter(F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = v.withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e")))).filter("norm > 0")
    return v.select("vec_id", F.transform("e", lambda x: x / F.col("norm")).alias("unit"))


def write_index(vectors: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = materialize(units(vectors))
    some = materialize(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(array_to_vector("unit").alias("features")))
    k = min(lists, some.count())
    if k < 2:
        placed, centres = rows.withColumn("list", F.lit(0)), [r.unit for r in rows.limit(k).select("unit").collect()]
    else:
        model = KMeans(k=k, seed=seed, maxIter=5, initSteps=1, distanceMeasure="cosine").fit(some)
        placed = model.transform(rows.withColumn("features", array_to_vector("unit"))).select("vec_id", "unit", F.col("prediction").alias("list"))
        centres = [c.tolist() for c in model.clusterCenters()]
    long = lambda c: sum(x * x for x in c) ** 0.5
    centroids = spark.createDataFrame([(i, [x / (long(c) or 1.0) for x in c]) for i, c in enumerate(centres)], "list int, centroid array<double>")
    placed.repartition("list").write.partitionBy("list").parquet(f"{path}/vectors")
    stored = spark.read.schema("vec_id long, unit array<double>, list int").parquet(f"{path}/vectors")
    angle = F.acos(F.least(F.greatest(dot(F.col("unit"), F.col("centroid")), F.lit(-1.0)), F.lit(1.0)))
    stored.join(F.broadcast(centroids), "list").groupBy("list").agg(F.first("centroid").alias("centroid"), F.max(angle).alias("radius"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/lists")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.schema("vec_id long, unit array<double>, list int").parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/lists"))


def bounds(index: VectorIndex, q: DataFrame) -> DataFrame:
    """query_id, list, n, bound (of the cosine to the list's members) and before (vectors in the lists of better bounds)."""
    every = index.lists.agg(F.collect_list(F.struct("list", "centroid", "radius", "n"))).scalar()
    s = q.select("query_id", "q", F.explode(every).alias("l"))
    angle = F.acos(F.least(F.greatest(dot(F.col("q"), F.col("l.centroid")), F.lit(-1.0)), F.lit(1.0)))
    s = s.select("query_id", "l.list", "l.n", F.cos(F.greatest(angle - F.col("l.radius"), F.lit(0.0))).alias("bound"), angle.alias("angle"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "angle", "list")
    return s.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("place", F.row_number().over(order))


def _block_nearest(vectors: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id and dot: at least the ``k`` nearest in a block, its ties included.

    A matrix product finds who is within the rounding of the k-th; their dots are summed in order, as ``dot`` does. Of
    vectors with one dot the ``k`` smallest ids stay.
    """
    ids, asking = (t.column(c).to_numpy() for t, c in ((vectors, "vec_id"), (asked, "query_id")))
    out: list[tuple] = []
    if len(ids) and len(asking):
        v, q = (t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t, c in ((vectors, "unit"), (asked, "q")))
        step = max(1, PAIRS // len(ids))
        for at in range(0, len(asking), step):
            mine = asking[at : at + step]
            s = q[at : at + step] @ v.T
            s[mine[:, None] == ids] = -np.inf
            least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(mine), -2.0)
            i, j = np.nonzero(s >= np.maximum(least - 3e-6, -2.0)[:, None])
            exact = np.zeros(len(i))
            for c in range(v.shape[1]):
                exact += v[j, c] * q[at + i, c]
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i))
            first = np.r_[True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])] if len(i) else np.zeros(0, bool)
            kept = place - np.maximum.accumulate(np.where(first, place, 0)) < k
            out.append((mine[i[kept]], ids[j[kept]], exact[kept]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)]
    return pa.table(dict(zip(("query_id", "vec_id", "dot"), columns)))


def _nearest(index: VectorIndex, q: DataFrame, opened: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, cosine, rank of the ``k`` nearest in the opened lists, the query's own row left out."""
    blocks = -(-(index.lists.agg(F.max("n")).first()[0] or 1) // BLOCK)
    parts = -(-max(q.count(), 1) // BLOCK)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    vectors = index.vectors.select("list", dealt("vec_id", blocks).alias("block"), spread(parts).alias("part"), "vec_id", "unit")
    asked = opened.select("query_id", "list").join(shuffled(q), "query_id").select("list", spread(blocks).alias("block"), dealt("query_id", parts).alias("part"), "query_id", "q")
    keys = ["list", "block", "part"]
    found = vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda v, a: _block_nearest(v, a, k), "query_id long, vec_id long, dot double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.select("query_id", "vec_id", r6(F.col("dot")).alias("cosine")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, cosine of the ``k`` nearest other vectors; ties to the smaller id. With ``probes``, of so many
    lists only (by bound), else exact."""
    q = materialize(units(queries).select(F.col("vec_id").alias("query_id"), F.col("unit").alias("q")))
    b = materialize(bounds(index, q))
    if probes is not None:
        return _nearest(index, q, materialize(b.filter(F.col("place") <= probes)), k).select("query_id", "rank", "vec_id", "cosine")
    near = _nearest(index, q, materialize(b.filter(F.col("before") < FIRST * k)), k).groupBy("query_id").agg(F.count("*").alias("got"), F.min("cosine").alias("kth"))
    bar = near.select("query_id", F.when(F.col("got") >= k, F.col("kth") - 2e-6).otherwise(-2.0).alias("bar"))
    opened = materialize(b.join(bar, "query_id", "left").filter(F.col("bound") >= F.coalesce("bar", F.lit(-2.0))).select("query_id", "list"))
    return _nearest(index, q, opened, k).select("query_id", "rank", "vec_id", "cosine")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """``search`` in an index of ``vectors`` that is written to the shared folder."""
    return search(write_index(vectors, new_path(vectors.sparkSession), **options), queries, k)
