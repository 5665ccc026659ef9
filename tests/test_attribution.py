import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidewatch.operators import attribution

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(7)
    x = rng.random((400, 4)).round(3)
    y = 2 * x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0.5, x[:, 3], -x[:, 0])
    rows = spark.createDataFrame([(f"k{i % 5}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "country string, a double, b double, c double, d double, y double").cache()
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=6, maxDepth=4, seed=1).fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))
    return rows, model, attribution.leaves(model, FEATURES)


def value(leaves, x):
    return sum(leaf.value for leaf in leaves if all(low < x[f] <= high for f, (low, high) in leaf.path.items()))


@pytest.mark.parametrize("baseline", [{}, {"a": 0.4, "b": 0.9, "c": 0.6, "d": 0.1}])
def test_equal_to_all_subsets(fitted, baseline):
    rows, model, leaves = fitted
    base = {f: baseline.get(f, 0.0) for f in FEATURES}
    columns = attribution.shapley(leaves, FEATURES, baseline)
    n = len(FEATURES)
    for r in rows.limit(40).select("*", *[c.alias(f"phi_{f}") for f, c in columns.items()]).collect():
        at = lambda s: value(leaves, {f: r[f] if f in s else base[f] for f in FEATURES})
        for f in FEATURES:
            others = [g for g in FEATURES if g != f]
            want = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (at({*s, f}) - at(set(s))) for k in range(n) for s in combinations(others, k))
            assert r[f"phi_{f}"] == pytest.approx(want, abs=1e-9)


def test_contributions_add_up_to_the_models_difference(fitted):
    rows, model, leaves = fitted
    x = VectorAssembler(inputCols=FEATURES, outputCol="x")
    zero = model.transform(x.transform(rows.limit(1).select(*[F.lit(0.0).alias(f) for f in FEATURES]))).first().prediction
    columns = attribution.shapley(leaves, FEATURES, {})
    total = columns["a"] + columns["b"] + columns["c"] + columns["d"]
    worst = model.transform(x.transform(rows.withColumn("total", total))).agg(F.max(F.abs(F.col("prediction") - zero - F.col("total")))).first()[0]
    assert worst < 1e-9
    at_zero = rows.limit(1).select(*[F.lit(0.0).alias(f) for f in FEATURES]).select(*[c.alias(f) for f, c in columns.items()]).first()
    assert set(at_zero) == {0.0}


def test_ranks_by_key(fitted):
    rows, _, leaves = fitted
    got = attribution.attribute_trees(rows, leaves, FEATURES).collect()
    assert len(got) == 20 and all(abs(r.contribution) <= r.magnitude + 1e-6 for r in got) and sorted(r["rank"] for r in got if r.country == "k0") == [1, 2, 3, 4]
    assert attribution.attribute_trees(rows.limit(0), leaves, FEATURES).collect() == []
