"""Walk-forward evaluation of fitted forecasters: every fold's model in one plan.

A sample is a country at a snapshot, with the values of the last snapshots as features and the value some snapshots ahead
as target. Linear models need their samples only as sums of products (the normal equations), so the equations are summed
by snapshot and the sums run along the snapshots: a fold's model is the solution at the last snapshot whose target was known
at the fold. Nothing is fitted in a loop, and no fold sees a target beyond its own date. Bootstrap replicates weigh samples
by counts that a hash of country, snapshot and replicate gives, so they come from the same scan and any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import r6


def samples(snapshots: DataFrame, value: str, context: int = 6, horizons=(1, 2, 3, 4)) -> DataFrame:
    """country, step, pivot_date, origin, x (1 and the last ``context`` values, newest first; 0 where absent), horizon (in
    snapshots), target_date and y (null where absent) of each country and snapshot. Snapshots are numbered over all countries."""
    dates = snapshots.select("snapshot_date").distinct().withColumn("step", F.dense_rank().over(Window.orderBy("snapshot_date")))
    s = snapshots.filter(F.col(value).isNotNull()).join(dates, "snapshot_date").select("country", "step", F.col("snapshot_date").alias("pivot_date"), F.col(value).cast("double").alias("origin"))
    at = lambda k: F.max("origin").over(Window.partitionBy("country").orderBy("step").rangeBetween(k, k))
    x = F.array(F.lit(1.0), *[F.coalesce(at(-k), F.lit(0.0)) for k in range(context)])
    s = s.select("country", "step", "pivot_date", "origin", x.alias("x"), F.array(*[at(h) for h in horizons]).alias("ys"))
    s = s.select("country", "step", "pivot_date", "origin", "x", F.posexplode("ys").alias("h", "y"))
    s = s.withColumn("horizon", F.get(F.array(*map(F.lit, horizons)), F.col("h"))).drop("h")
    last = dates.select((F.col("step")).alias("__step"), F.col("snapshot_date").alias("target_date"))
    return s.join(F.broadcast(last), F.col("step") + F.col("horizon") == F.col("__step"), "left").drop("__step")


def solved(matrix: Column, size: int) -> Column:
    """Solution of the symmetric positive system whose rows, right side last, are the arrays of ``matrix``; null if singular."""
    def eliminated(m: Column, k: Column) -> Column:
        pivot = F.transform(F.get(m, k), lambda v: F.try_divide(v, F.get(F.get(m, k), k)))
        return F.transform(m, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda v, p: v - F.get(row, k) * p)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, eliminated)
    return F.transform(done, lambda row: F.element_at(row, -1))


def fold_models(rows: DataFrame, features: int, ridge: float = 0.0, weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, horizon, fold, n and beta: the least-squares model of each horizon from the samples whose target was known at
    the fold. ``rows`` are ``samples`` with ``features`` values in x, weighted by ``weight``."""
    w = F.when(F.col("y").isNull(), 0.0).otherwise(1.0 if weight is None else weight)
    x, y = [F.get("x", F.lit(i)) for i in range(features)], F.coalesce("y", F.lit(0.0))
    cells = {f"a{i}_{j}": w * x[i] * x[j] for i in range(features) for j in range(i, features)} | {f"b{i}": w * x[i] * y for i in range(features)} | {"n": w}
    by_step = rows.groupBy(*keys, "horizon", "step").agg(*[F.sum(c).alias(name) for name, c in cells.items()])
    along = Window.partitionBy(*keys, "horizon").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = by_step.select(*keys, "horizon", (F.col("step") + F.col("horizon")).alias("fold"), *[F.sum(name).over(along).alias(name) for name in cells])
    damped = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}") + (ridge if i == j and i else 0.0)
    matrix = F.array(*[F.array(*[damped(i, j) for j in range(features)], F.col(f"b{i}")) for i in range(features)])
    return run.filter(F.col("n") > features).select(*keys, "horizon", "fold", "n", solved(matrix, features).alias("beta"))


def predicted(rows: DataFrame, models: DataFrame, burn_in: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Forecasts of the folds after the first ``burn_in`` snapshots by the models of ``fold_models``, cut to 0 and 1; the
    origin is carried forward where a system has no solution."""
    m = models.withColumnRenamed("horizon", "__horizon")
    j = rows.filter(F.col("step") > burn_in).join(m, (F.col("step") == F.col("fold")) & (F.col("horizon") == F.col("__horizon")))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    unit = F.least(F.greatest(F.coalesce(dot, F.col("origin")), F.lit(0.0)), F.lit(1.0))
    return j.select(*keys, "country", "pivot_date", F.col("step").alias("fold"), F.col("origin").alias("origin_risk"), "horizon", "target_date", r6(unit).alias("predicted"), F.col("y").alias("actual"))


def walk_forward(snapshots: DataFrame, value: str, context: int = 6, horizons=(1, 2, 3, 4), burn_in: int = 14, ridge: float = 0.01) -> DataFrame:
    """country, pivot_date, fold, origin_risk, horizon, target_date, predicted, actual: each fold forecast by a model of its past."""
    rows = samples(snapshots, value, context, horizons)
    return predicted(rows, fold_models(rows, context + 1, ridge), burn_in)


def poisson_counts(key: Column, most: int = 8) -> Column:
    """A count with the Poisson distribution of mean 1, from the first 32 bits of the MD5 of ``key``."""
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    out, below = F.lit(float(most)), 0.0
    bounds = []
    for k in range(most):
        below += math.exp(-1) / math.factorial(k)
        bounds.append((k, int(below * 2**32)))
    for k, bound in reversed(bounds):
        out = F.when(u < bound, float(k)).otherwise(out)
    return out


def bootstrap_forecasts(snapshots: DataFrame, value: str, replicates: int = 20, context: int = 6, horizons=(1, 2, 3, 4), burn_in: int = 14, ridge: float = 0.01) -> DataFrame:
    """``walk_forward`` by ``replicates`` models a fold: replicate and predicted, all fitted from one scan."""
    rows = samples(snapshots, value, context, horizons)
    many = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    weight = poisson_counts(F.concat_ws("|", "country", "step", "replicate"))
    models = fold_models(many, context + 1, ridge, weight, ("replicate",))
    return predicted(rows, models, burn_in, ("replicate",))


def bootstrap_intervals(forecasts: DataFrame, z: float = 1.28) -> DataFrame:
    """country, pivot_date, origin_risk, horizon, target_date, actual, predicted (the mean), variance, confidence, lower, upper."""
    g = forecasts.groupBy("country", "pivot_date", "origin_risk", "horizon", "target_date", "actual").agg(F.avg("predicted").alias("m"), F.var_samp("predicted").alias("v"))
    unit = lambda c: r6(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    v = F.coalesce("v", F.lit(0.0))
    return g.select(
        "country", "pivot_date", "origin_risk", "horizon", "target_date", "actual", r6(F.col("m")).alias("predicted"), r6(v).alias("variance"),
        unit(1.0 - v).alias("confidence"), unit(F.col("m") - z * F.sqrt(v)).alias("lower"), unit(F.col("m") + z * F.sqrt(v)).alias("upper"))
