"""Exact Shapley values of tree ensembles against one baseline, as column programs.

A leaf is reached where each feature of its path lies in the path's interval. Taking some features from a row and the others from
the baseline, a leaf is reached by the coalitions that hold every feature only the row has in its interval (a of them) and none
that only the baseline has (b of them), so its value v adds v (a-1)! b! / (a+b)! to each of the former and takes v a! (b-1)! / (a+b)!
from each of the latter. The baseline is fixed, so for a leaf a is a constant and b a count, and the leaves are a constant
array that each row goes through. Contributions of a row add up to f(row) - f(baseline).
"""

from __future__ import annotations

import json
from math import factorial, inf
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6


class Leaf(NamedTuple):
    value: float
    #: by feature: above the first, at most the second
    path: dict[str, tuple[float, float]]


def leaves(model, features: list[str]) -> list[Leaf]:
    """The leaves of a fitted Spark ML tree ensemble (or one tree) over ``features``, weighted by their trees."""
    trees, weights = (model.trees, model.treeWeights) if hasattr(model, "trees") else ([model], [1.0])
    found: list[Leaf] = []

    def walk(node, path: dict[str, tuple[float, float]], weight: float) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            found.append(Leaf(weight * node.prediction(), path))
            return
        split = node.split()
        name, bound = features[split.featureIndex()], split.threshold()
        low, high = path.get(name, (-inf, inf))
        walk(node.leftChild(), path | {name: (low, min(high, bound))}, weight)
        walk(node.rightChild(), path | {name: (max(low, bound), high)}, weight)

    for tree, weight in zip(trees, weights):
        walk(tree._java_obj.rootNode(), {}, float(weight))
    return found


_PART = "array<struct<feature: string, i: int, low: double, high: double>>"
_LEAVES = f"array<struct<only_row: {_PART}, shared: {_PART}, given: array<double>, lost: array<double>>>"


def _table(found: list[Leaf], features: list[str], baseline: dict[str, float]) -> Column:
    """The leaves as one constant array: their paths in two parts, and what each count of features outside gives and takes."""
    rows = []
    for leaf in found:
        part = {True: [], False: []}
        for f, (low, high) in leaf.path.items():
            part[low < baseline.get(f, 0.0) <= high].append({"feature": f, "i": features.index(f), "low": low if low > -inf else None, "high": high if high < inf else None})
        a, counts = len(part[False]), range(len(part[True]) + 1)
        rows.append({
            "only_row": part[False], "shared": part[True],
            "given": [leaf.value * factorial(a - 1) * factorial(n) / factorial(a + n) if a else 0.0 for n in counts],
            "lost": [leaf.value * factorial(a) * factorial(n - 1) / factorial(a + n) if n else 0.0 for n in counts]})
    return F.from_json(F.lit(json.dumps(rows)), _LEAVES)


def contributions(found: list[Leaf], features: list[str], baseline: dict[str, float]) -> Column:
    """feature and c for each leaf and feature that it says something of: their sums are the Shapley values against ``baseline``
    (0 where a feature is absent there). Leaves are data, so the program is as small for many trees as for one."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    inside = lambda p: (p["low"].isNull() | (F.get(x, p["i"]) > p["low"])) & (p["high"].isNull() | (F.get(x, p["i"]) <= p["high"]))

    def of(leaf: Column) -> Column:
        outside = F.filter(leaf["shared"], lambda p: ~inside(p))
        given, lost = F.get(leaf["given"], F.size(outside)), F.get(leaf["lost"], F.size(outside))
        entry = lambda c: lambda p: F.struct(p["feature"].alias("feature"), c.alias("c"))
        return F.concat(F.transform(leaf["only_row"], entry(given)), F.transform(outside, entry(-lost)))

    reached = F.filter(_table(found, features, baseline), lambda leaf: F.forall(leaf["only_row"], inside))
    return F.flatten(F.transform(reached, of))


def shapley(found: list[Leaf], features: list[str], baseline: dict[str, float]) -> dict[str, Column]:
    """By feature, the Shapley value of a row's columns against ``baseline``."""
    every = contributions(found, features, baseline)
    value = lambda f: F.aggregate(F.filter(every, lambda e: e["feature"] == f), F.lit(0.0), lambda s, e: s + e["c"])
    return {f: value(f) for f in features}


def attribute_trees(rows: DataFrame, found: list[Leaf], features: list[str], baseline: dict[str, float] | None = None, key: str = "country") -> DataFrame:
    """key, feature, contribution (summed over the key's rows), magnitude and rank by magnitude."""
    every = F.concat(contributions(found, features, baseline or {}), F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(0.0).alias("c")) for f in features]))
    sums = F.transform(F.array(*map(F.lit, features)), lambda f: F.struct(f.alias("feature"), F.aggregate(F.filter("every", lambda e: e["feature"] == f), F.lit(0.0), lambda s, e: s + e["c"]).alias("c")))
    each = rows.select(key, F.explode(F.array(every)).alias("every")).select(key, F.explode(sums).alias("p"))
    g = each.groupBy(key, "p.feature").agg(r6(F.sum("p.c")).alias("contribution"), r6(F.sum(F.abs("p.c"))).alias("magnitude"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("magnitude"), "feature")))
