"""Backtest metrics, conformal calibration and classification metrics, each as one grouped plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import level_bin, n_if, r6, risk_tier, share
from tidewatch.operators.order_stats import at_ranks, running
from tidewatch.sources.scratch import materialize


def actuals_at_horizon(predictions: DataFrame, risk: DataFrame, how: str = "left") -> DataFrame:
    """Predictions with the risk on their exact target date."""
    a = risk.select("country", F.col("feature_date").alias("target_date"), F.col("risk_score").alias("actual"))
    return predictions.join(a, ["country", "target_date"], how)


def _skill(mae: Column, base: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise((base - mae) / base)


def _metrics() -> list[Column]:
    e, b = F.abs(F.col("actual") - F.col("predicted")), F.abs(F.col("actual") - F.col("origin_risk"))
    mape = F.avg(F.when(F.col("actual") > 0.01, e / F.col("actual")))
    direction = F.signum(F.col("actual") - F.col("origin_risk")) == F.signum(F.col("predicted") - F.col("origin_risk"))
    return [
        F.count("*").alias("n"), r6(F.avg(e), 4).alias("mae"), r6(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        r6(100.0 * mape, 2).alias("mape"), r6(share(direction), 4).alias("directional_accuracy"),
        r6(share(F.col("actual").between(F.col("lower"), F.col("upper"))), 4).alias("coverage"), r6(_skill(F.avg(e), F.avg(b)), 4).alias("skill"),
    ]


def horizon_metrics(scored: DataFrame) -> DataFrame:
    """scored: country, horizon_days, origin_risk, predicted, lower, upper, actual; null actuals are left out."""
    return scored.filter("actual is not null").groupBy("horizon_days").agg(*_metrics())


def tier_metrics(scored: DataFrame) -> DataFrame:
    e = F.abs(F.col("actual") - F.col("predicted"))
    return scored.filter("actual is not null").groupBy(risk_tier(F.col("origin_risk")).alias("tier")).agg(F.count("*").alias("n"), r6(F.avg(e), 4).alias("mae"), r6(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


def overall_metrics(scored: DataFrame) -> DataFrame:
    e, b = F.abs(F.col("actual") - F.col("predicted")), F.abs(F.col("actual") - F.col("origin_risk"))
    return scored.filter("actual is not null").agg(
        F.count("*").alias("predictions"), F.count_distinct("country").alias("countries"), F.count_distinct("pivot_date").alias("folds"),
        r6(F.avg(e), 4).alias("mae"), r6(F.sqrt(F.avg(e * e)), 4).alias("rmse"), r6(_skill(F.avg(e), F.avg(b)), 4).alias("skill"))


def fold_log(scored: DataFrame) -> DataFrame:
    return scored.filter("actual is not null").select("country", "pivot_date", "horizon_days", "target_date", "predicted", "actual", r6(F.abs(F.col("actual") - F.col("predicted"))).alias("abs_error"))


def conformal_quantiles(scored: DataFrame, alpha: float = 0.2, min_tier: int = 30) -> DataFrame:
    """level, horizon_days, tier, n, q: order statistic min(ceil((n+1)(1-alpha)), n) of the residuals, overall, per horizon
    and per (horizon, tier). Ranks come from ranges of residuals, so that the global level needs no single ordered task.
    """
    r = scored.filter("actual is not null").select("horizon_days", risk_tier(F.col("origin_risk")).alias("tier"), r6(F.abs(F.col("actual") - F.col("predicted"))).alias("residual"))
    r = materialize(r)
    out = None
    for level, keys in (("global", []), ("horizon", ["horizon_days"]), ("tier", ["horizon_days", "tier"])):
        q = at_ranks(r, keys, "residual", {"q": F.least(F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9), F.col("n"))})
        q = q.filter(F.col("n") >= min_tier) if level == "tier" else q
        q = q.select(F.lit(level).alias("level"), (F.col("horizon_days") if "horizon_days" in keys else F.lit(None).cast("int")).alias("horizon_days"), (F.col("tier") if "tier" in keys else F.lit(None).cast("string")).alias("tier"), "n", "q")
        out = q if out is None else out.unionByName(q)
    return out


def calibrated(predictions: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Predictions with an interval of the finest quantile there is: tier, else horizon, else global; clamped to [0, 1]."""
    p = predictions.withColumn("tier", risk_tier(F.col("origin_risk")))
    t = quantiles.filter("level = 'tier'").select("horizon_days", "tier", F.col("q").alias("q_tier"))
    h = quantiles.filter("level = 'horizon'").select("horizon_days", F.col("q").alias("q_horizon"))
    q = F.coalesce("q_tier", "q_horizon", quantiles.filter("level = 'global'").select(F.max("q")).scalar())
    p = p.join(t, ["horizon_days", "tier"], "left").join(h, "horizon_days", "left").withColumn("half_width", q).drop("q_tier", "q_horizon")
    return p.withColumns({"lower": r6(F.greatest(F.col("predicted") - F.col("half_width"), F.lit(0.0))), "upper": r6(F.least(F.col("predicted") + F.col("half_width"), F.lit(1.0)))})


def coverage_report(scored: DataFrame) -> DataFrame:
    """n, coverage and mean width over all, by horizon and by tier: one scan with grouping sets."""
    s = scored.filter("actual is not null").withColumn("tier", risk_tier(F.col("origin_risk")))
    g = s.groupingSets([[], [F.col("horizon_days")], [F.col("tier")]], F.col("horizon_days"), F.col("tier"))
    return g.agg(F.count("*").alias("n"), r6(share(F.col("actual").between(F.col("lower"), F.col("upper"))), 4).alias("coverage"), r6(F.avg(F.col("upper") - F.col("lower")), 4).alias("mean_width"))


def raw_coverage(scored: DataFrame) -> DataFrame:
    return scored.filter("actual is not null").agg(r6(share(F.col("actual").between(F.col("lower"), F.col("upper"))), 4).alias("coverage"))


def ensemble_interval(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Over repeated predictions: mean, sample variance, confidence and a 10-90 band."""
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return samples.groupBy(*keys).agg(
        r6(F.avg("value")).alias("mean"), r6(sd * sd).alias("variance"), r6(unit(1.0 - sd * sd)).alias("confidence"),
        r6(unit(F.avg("value") - 1.28 * sd)).alias("lower"), r6(unit(F.avg("value") + 1.28 * sd)).alias("upper"))


def regression_metrics(rows: DataFrame) -> DataFrame:
    """rows: task, label, score. Per task MAE, MSE, the MAE of the mean label and the skill over it."""
    mean = rows.groupBy("task").agg(F.avg("label").alias("mean"))
    e = F.abs(F.col("label") - F.col("score"))
    base = F.avg(F.abs(F.col("label") - F.col("mean")))
    return rows.join(mean, "task").groupBy("task").agg(F.count("*").alias("n"), r6(F.avg(e), 4).alias("mae"), r6(F.avg(e * e), 4).alias("mse"), r6(base, 4).alias("baseline_mae"), r6(_skill(F.avg(e), base), 4).alias("skill"))


def ranked_metrics(rows: DataFrame) -> DataFrame:
    """auc_roc (ties averaged), auc_pr and f1 at 0.5 per task; labels count as positive from 0.5; one class gives null AUCs.

    Rows are counted per distinct score, and the running counts come from ranges of scores.
    """
    y = F.col("label") >= 0.5
    c = rows.groupBy("task", "score").agg(n_if(y).alias("pos"), n_if(~y).alias("neg"))
    c = running(c, ["task"], "score", ["pos", "neg"], descending=True).withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp"})
    p, n, tp, fp = F.sum("pos"), F.sum("neg"), F.col("tp"), F.col("fp")
    roc = F.sum(F.col("neg") * (tp - F.col("pos") / 2.0)) / (p * n)
    pr = F.sum(F.col("pos") * tp / (tp + fp)) / p
    hit, called = F.sum(F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(0)), F.sum(F.when(F.col("score") >= 0.5, F.col("pos") + F.col("neg")).otherwise(0))
    both = (p > 0) & (n > 0)
    return c.groupBy("task").agg(
        r6(F.when(both, roc), 4).alias("auc_roc"), r6(F.when(both, pr), 4).alias("auc_pr"),
        r6(F.coalesce(F.try_divide(2.0 * hit, (called + p).cast("double")), F.lit(0.0)), 4).alias("f1"))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """|mean confidence - share of errors under 0.1| weighted by bin share; a confidence of exactly 1 falls in no bin."""
    b = rows.withColumn("bin", F.floor(F.col("confidence") * bins + 1e-12)).withColumn("ok", F.when(F.abs(F.col("label") - F.col("score")) < 0.1, 1.0).otherwise(0.0))
    total = rows.agg(F.count("*")).scalar()
    g = b.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg("ok")).alias("gap"))
    return g.select((F.col("n") * F.col("gap") / total).alias("part")).agg(r6(F.sum("part"), 4).alias("ece"))


def error_coverage(rows: DataFrame) -> DataFrame:
    e = F.abs(F.col("label") - F.col("score"))
    return rows.groupBy("task").agg(r6(share(e <= 0.1), 4).alias("within_10"), r6(share(e <= 0.2), 4).alias("within_20"), r6(F.avg("confidence"), 4).alias("mean_confidence"))


def level_agreement(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task").agg(r6(share(level_bin(F.col("label")) == level_bin(F.col("score"))), 4).alias("level_accuracy"), r6(F.corr("label", "score"), 4).alias("pearson_r"))


def horizon_weighted_mse(rows: DataFrame, decay: float = 0.2, floor: float = 0.4) -> DataFrame:
    """rows: task, step (from 0), label, score. Weighted by max(floor, 1 - decay * step)."""
    w = F.greatest(F.lit(floor), 1.0 - decay * F.col("step"))
    return rows.groupBy("task").agg(r6(F.sum(w * F.pow(F.col("label") - F.col("score"), 2)) / F.sum(w)).alias("weighted_mse"), r6(F.avg(F.pow(F.col("label") - F.col("score"), 2))).alias("mse"))


def ab_compare(rows: DataFrame) -> DataFrame:
    """rows: horizon_days, base, adjusted, actual."""
    a, b = F.avg(F.abs(F.col("actual") - F.col("base"))), F.avg(F.abs(F.col("actual") - F.col("adjusted")))
    return rows.filter("actual is not null").groupBy("horizon_days").agg(
        F.count("*").alias("n"), r6(a, 4).alias("mae_base"), r6(b, 4).alias("mae_adjusted"), r6(_skill(b, a), 4).alias("skill"),
        r6(F.corr("base", "actual"), 4).alias("r_base"), r6(F.corr("adjusted", "actual"), 4).alias("r_adjusted"))


def extremes(rows: DataFrame, key: str, column: str, n: int = 5) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest, by two bounded sorts."""
    top = rows.orderBy(F.desc(column), key).limit(n).select(key, column, F.lit("top").alias("end"))
    return top.unionByName(rows.orderBy(F.asc(column), key).limit(n).select(key, column, F.lit("bottom").alias("end")))
