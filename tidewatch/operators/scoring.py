"""Risk scores, forecasts and attributions as column programs over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import composite, r6
from tidewatch.operators.features import SCORES
from tidewatch.operators.timeseries import dense_window, tail_means, trend_slope



def _cap(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def snapshot_risk(features: DataFrame) -> DataFrame:
    """Heads and risk of each (country, day) row by itself, with the goldstein term in war."""
    v, p, d, t, e, s, g = (F.col(c) for c in ("violence_score", "protest_score", "diplomatic_stress", "terrorism_score", "economic_stress", "avg_sentiment", "avg_goldstein"))
    f = features.withColumns({
        "instability": r6(_cap(0.5 * v + 0.5 * p)), "war": r6(_cap(0.4 * v + 0.4 * d + 0.2 * g)),
        "terrorism": r6(_cap(1.2 * t)), "financial": r6(_cap(0.7 * e + 0.3 * s)),
    })
    return f.withColumn("risk_score", r6(composite(*[F.col(c) for c in ("instability", "war", "terrorism", "financial")])))


def score_countries(features: DataFrame, seq_len: int = 90, last: int = 14, as_of: str | None = None) -> DataFrame:
    """All countries at once: heads from the means of the last days of the dense window, confidence from coverage."""
    m = tail_means(dense_window(features, list(SCORES), seq_len, as_of), list(SCORES), last)
    v, p, d, t, e = (F.col(c) for c in ("violence_score", "protest_score", "diplomatic_stress", "terrorism_score", "economic_stress"))
    h = m.select("country", r6(_cap(0.6 * v + 0.4 * p)).alias("instability"), r6(_cap(0.7 * v + 0.3 * d)).alias("war"), r6(_cap(1.2 * t)).alias("terrorism"), r6(_cap(1.1 * e)).alias("financial"), r6(0.6 * F.col("coverage")).alias("confidence"))
    return h.withColumn("risk_score", r6(composite(*[F.col(c) for c in ("instability", "war", "terrorism", "financial")])))


def proxy_labels_from_window(means: DataFrame) -> DataFrame:
    """Labels from tail means named protest, violence, diplo, econ, terror, tone_neg, goldstein_norm."""
    v, p, d, e, t, s = (F.col(c) for c in ("violence", "protest", "diplo", "econ", "terror", "tone_neg"))
    c = 1.0 - F.col("goldstein_norm")
    unit = lambda x: r6(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return means.select(
        "country", unit(0.4 * p + 0.3 * v + 0.2 * d + 0.1 * c).alias("instability"), unit(0.5 * v + 0.3 * d + 0.2 * c).alias("war"),
        unit(0.7 * t + 0.2 * v + 0.1 * s).alias("terrorism"), unit(0.7 * _cap(2.5 * e) + 0.2 * s + 0.1 * c).alias("financial"))


def forecast_trend(features: DataFrame, horizons=(14, 28, 42, 56), seq_len: int = 90, last: int = 30, as_of: str | None = None) -> DataFrame:
    """Level plus half the slope per day, for every country and horizon, with a fixed band."""
    dense = dense_window(features, list(SCORES), seq_len, as_of)
    m = tail_means(dense, list(SCORES), last).join(trend_slope(dense, "violence_score", last), "country")
    v, p, d, t, e, s = (F.col(c) for c in ("violence_score", "protest_score", "diplomatic_stress", "terrorism_score", "economic_stress", "avg_sentiment"))
    base = composite(_cap(0.5 * v + 0.5 * p), _cap(0.4 * v + 0.4 * d), _cap(1.2 * t), _cap(0.7 * e + 0.3 * s))
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("horizon_step"), F.lit(h).alias("horizon_days")) for i, h in enumerate(horizons)]))
    f = m.select("country", base.alias("base"), "slope", steps.alias("h")).select("country", "h.*", "base", "slope")
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    f = f.withColumn("risk_score", r6(unit(F.col("base") + F.col("slope") * F.col("horizon_days") * 0.5)))
    return f.select("country", "horizon_step", "horizon_days", "risk_score", r6(unit(F.col("risk_score") - 0.08)).alias("lower_bound"), r6(unit(F.col("risk_score") + 0.08)).alias("upper_bound"), F.lit(0.40).alias("confidence"), F.lit(0.05).alias("variance"))


def forecast_persistence(folds: DataFrame, horizons=(7, 14)) -> DataFrame:
    """Carry-forward: the origin's risk at every horizon."""
    return folds.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_days")).withColumn("target_date", F.expr("date_add(pivot_date, horizon_days)")).withColumn("predicted", F.col("origin_risk"))


def attribute_features(features: DataFrame, weights: dict[str, float], baseline: dict[str, float] | None = None) -> DataFrame:
    """Integrated gradients of a linear scorer, weight * (x - baseline), summed over each country's days.

    Per feature the contribution, its magnitude and its rank; contributions add up to f(x) - f(baseline).
    """
    part = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), (F.lit(float(w)) * (F.col(n) - F.lit(float((baseline or {}).get(n, 0.0))))).alias("c")) for n, w in weights.items()]))
    g = features.select("country", part.alias("p")).groupBy("country", "p.feature").agg(r6(F.sum("p.c")).alias("contribution"), r6(F.sum(F.abs("p.c"))).alias("magnitude"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("magnitude"), "feature")))


def fit_forecaster(pairs: DataFrame, context: int = 6, targets: int = 4, max_iter: int = 20):
    """Spark ML regressors of the values 1 to ``targets`` steps ahead (p1, p2, ...) on the context values of ``context_target_pairs``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    steps = [LinearRegression(featuresCol="x", labelCol=f"t{k}", predictionCol=f"p{k}", maxIter=max_iter, regParam=0.01) for k in range(1, targets + 1)]
    return Pipeline(stages=[VectorAssembler(inputCols=[f"c{k}" for k in range(1, context + 1)], outputCol="x"), *steps]).fit(pairs)


def before_cut(pairs: DataFrame, cut: int, targets: int = 4) -> DataFrame:
    """Pairs whose last target lies at or before the snapshot number ``cut``: nothing after it is learned from."""
    return pairs.filter(F.col("step") + targets <= cut)


def fit_multitask_scorer(rows: DataFrame, features: list[str], tasks: list[str]) -> dict:
    """One boosted-tree regressor per task on window statistics."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return {t: Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), GBTRegressor(featuresCol="x", labelCol=t, predictionCol=f"{t}_predicted", maxIter=8, maxDepth=3, seed=7)]).fit(rows) for t in tasks}
