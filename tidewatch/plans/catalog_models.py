"""Queries over windows, scores, the network, evaluation, text, files and streams. Importing registers them."""

from __future__ import annotations


import math

from pyspark.sql import functions as F

from tidewatch import api

from tidewatch.operators import attribution, backtest, evaluate, features, labels, network, order_stats, retrieval, scoring, text, timeseries, vector_index
from tidewatch.plans.catalog import COOC, KIND, LABELS, LSTAT, ORACLE_SQL, QUAD, QUERIES, TIER, WEIGHTED, _weighted, daily, query, risk
from tidewatch.plans.fixtures import AS_OF, facts, table, with_sql
from tidewatch.sources import readers, sinks
from tidewatch.sources.history import History
from tidewatch.sources.scratch import materialize as _kept
from tidewatch.sources.scratch import new_path as scratch
from tidewatch.sources.versioned import VersionedTable
from tidewatch.streaming import jobs

COLS = list(features.SCORES)


# --- windows

LATEST = "latest as (select country, feature_date, risk_score from (select *, row_number() over (partition by country order by feature_date desc) as n from risk where risk_score is not null) where n = 1)"


@query("w1_latest_country_risk", with_sql("select * from latest", LATEST))
def latest_country_risk(spark, d):
    return timeseries.latest_country_risk(risk(spark, d).select("country", "feature_date", "risk_score"))


CORR = """corr_ as (select country_a, country_b, overlap, round(c + 1e-9, 6) as correlation from (select a.country as country_a, b.country as country_b, count(*) as overlap, corr(a.risk_score, b.risk_score) as c
  from risk a join risk b on a.feature_date = b.feature_date and a.country < b.country group by 1, 2) where overlap >= 20 and c is not null and not isnan(c))"""
ADJ = "adj as (select a.n_name as country_a, b.n_name as country_b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name)"
EDGES = """cn as (select country_a, country_b, ln(1 + events) / (select max(ln(1 + events)) from cooc) as cooc from cooc),
edges as (select coalesce(c.country_a, n.country_a) as country_a, coalesce(c.country_b, n.country_b) as country_b, coalesce(correlation, 0) as correlation, round(coalesce(cooc, 0) + 1e-9, 6) as cooccurrence,
  adj.country_a is not null as is_adjacent, round(case when adj.country_a is not null then least(0.5 * abs(coalesce(correlation, 0)) + 0.5 * coalesce(cooc, 0) + 0.15, 1) else 0.5 * abs(coalesce(correlation, 0)) + 0.5 * coalesce(cooc, 0) end + 1e-9, 6) as weight
  from corr_ c full join cn n on c.country_a = n.country_a and c.country_b = n.country_b
  left join adj on adj.country_a = coalesce(c.country_a, n.country_a) and adj.country_b = coalesce(c.country_b, n.country_b)),
top_edges as (select * from edges order by weight desc, country_a, country_b limit 500)"""
NET = (CORR, COOC, ADJ, EDGES)
#: The read endpoints' edges: co-occurrence of the 21 days up to AS_OF.
RECENT = "2024-01-10", AS_OF
RECENT_NET = (CORR, COOC.replace("from facts where", f"from facts where event_date between date '{AS_OF}' - 20 and date '{AS_OF}' and"), ADJ, EDGES)


def _adjacent(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("country_a"), F.col("n_regionkey").alias("r"))
    b = n.select(F.col("n_name").alias("country_b"), F.col("n_regionkey").alias("s"))
    return a.join(b, (F.col("r") == F.col("s")) & (F.col("country_a") < F.col("country_b"))).select("country_a", "country_b")


def _correlations(spark, d):
    return network.risk_correlations(risk(spark, d), AS_OF, 90, 20)


def _edges(spark, d, start=None, end=None):
    return network.spillover_edges(_correlations(spark, d), network.cooccurrence(facts(spark, d), start, end, 2), _adjacent(spark, d))


@query("j5_risk_correlations", with_sql("select * from corr_", CORR))
def risk_correlations(spark, d):
    return _correlations(spark, d)


@query("j6_spillover_edges", with_sql("select * from top_edges", *NET))
def spillover_edges(spark, d):
    return _edges(spark, d)


@query("j7_correlation_edges", with_sql("""select country_a, country_b, weight from (select a.country as country_a, b.country as country_b, round(corr(a.risk_score, b.risk_score) + 1e-9, 6) as weight
  from risk a join risk b on a.feature_date = b.feature_date and a.country < b.country
  where a.country in (select country from full_) and b.country in (select country from full_) group by 1, 2) where abs(weight) >= 0.25""",
  "full_ as (select country from risk group by 1 having count(distinct feature_date) = (select count(distinct feature_date) from risk))"))
def correlation_edges(spark, d):
    return network.correlation_edges(risk(spark, d), 0.25)


NEIGH = """neigh as (select * from (select country_a as country, country_b as neighbor, weight, row_number() over (partition by country_a order by weight desc, country_b) as rank, 'a' as side from top_edges
  union all select country_b, country_a, weight, row_number() over (partition by country_b order by weight desc, country_a), 'b' from top_edges) where rank <= 5)"""


@query("w2_top_neighbors", with_sql("select * from neigh", *NET, NEIGH))
def top_neighbors(spark, d):
    return timeseries.top_neighbors(_edges(spark, d))


@query("w2_best_neighbors", with_sql("select country, neighbor, weight, rank from (select country, neighbor, weight, row_number() over (partition by country order by weight desc, neighbor) as rank from neigh) where rank <= 5", *NET, NEIGH))
def best_neighbors(spark, d):
    return timeseries.best_neighbors(_edges(spark, d))


GAPS = "gaps as (select * from features)"


def _gaps(spark, d):
    """The panel under the window queries: all rows; days without events are its gaps."""
    return daily(spark, d)


DENSE = lambda src, n=14: f"""span_ as (select country, unnest(generate_series(date '{AS_OF}' - {n - 1}, date '{AS_OF}', interval 1 day))::date as feature_date from (select distinct country from {src})),
dense as (select country, feature_date, row_number() over (partition by country order by feature_date)::int as pos, protest_score is not null as valid0,
  {', '.join(f'coalesce(last_value({c} ignore nulls) over (partition by country order by feature_date rows unbounded preceding), 0) as {c}' for c in COLS)}
  from span_ left join {src} using (country, feature_date))"""


@query("w3_dense_window", with_sql(f"select country, feature_date, pos, valid0 as valid, {', '.join(COLS)} from dense", GAPS, DENSE("gaps")))
def dense_window(spark, d):
    return timeseries.dense_window(_gaps(spark, d), COLS, 14, AS_OF)


@query("w4_trailing_context", with_sql("""select country, feature_date, coalesce(sum(total_events) over w, 0)::bigint as prior_total_events, coalesce(sum(conflict_events) over w, 0)::bigint as prior_conflict_events from gaps
  window w as (partition by country order by feature_date range between interval 7 days preceding and interval 1 day preceding)""", GAPS))
def trailing_context(spark, d):
    return timeseries.trailing_context(_gaps(spark, d), "country", "feature_date", ["total_events", "conflict_events"])


@query("w5_trend_7v7", with_sql("""select country, feature_date, delta, case when delta > 0.03 then 'increasing' when delta < -0.03 then 'decreasing' else 'stable' end as trend from (
  select country, feature_date, round(avg(risk_score) over (partition by country order by feature_date range between interval 7 days preceding and current row)
  - avg(risk_score) over (partition by country order by feature_date range between interval 14 days preceding and interval 7 days preceding) + 1e-9, 6) as delta from risk)"""))
def trend_7v7(spark, d):
    return timeseries.trend_7v7(risk(spark, d))


@query("w6_origin_risk", with_sql("select country, max(feature_date) as effective_date, arg_max(risk_score, feature_date) as origin_risk from risk where feature_date <= date '2024-01-20' group by 1"))
def origin_risk(spark, d):
    return timeseries.origin_risk(risk(spark, d), "2024-01-20")


T3 = """t3 as (select country, case when count(*) < 6 then 'stable' when round(avg(risk_score) filter (n <= 3) - avg(risk_score) filter (n > 3) + 1e-9, 6) > 0.02 then 'increasing'
  when round(avg(risk_score) filter (n <= 3) - avg(risk_score) filter (n > 3) + 1e-9, 6) < -0.02 then 'decreasing' else 'stable' end as trend
  from (select *, row_number() over (partition by country order by feature_date desc) as n from risk) where n <= 6 group by 1)"""


@query("w7_trend_3v3", with_sql("select * from t3", T3))
def trend_3v3(spark, d):
    return timeseries.trend_3v3(risk(spark, d))


TAIL = lambda last, n=14, name="tail_": f"""{name} as (select country, {', '.join(f'round(avg({c}) filter (pos > {n - last}) + 1e-9, 6) as {c}' for c in COLS)},
  round(avg(case when {' + '.join(COLS)} > 0 then 1.0::double else 0 end) + 1e-9, 6) as coverage from dense group by 1)"""


@query("w9_tail_means", with_sql("select * from tail_", GAPS, DENSE("gaps"), TAIL(5)))
def tail_means(spark, d):
    return timeseries.tail_means(timeseries.dense_window(_gaps(spark, d), COLS, 14, AS_OF), COLS, 5)


SLOPE = lambda last, n=14: f"slope_ as (select country, round(coalesce(regr_slope(violence_score, pos), 0) + 1e-9, 6) as slope from dense where pos > {n - last} group by 1)"


@query("w10_trend_slope", with_sql("select * from slope_", GAPS, DENSE("gaps"), SLOPE(10)))
def trend_slope(spark, d):
    return timeseries.trend_slope(timeseries.dense_window(_gaps(spark, d), COLS, 14, AS_OF), "violence_score", 10)


SLIDE = f"""slid as (select country, feature_date as end_date, sum(case when protest_score + violence_score > 0 then 1 else 0 end) over w as nonzero, round(sum(violence_score) over w + 1e-9, 6) as violence_sum, pos from dense
  window w as (partition by country order by pos rows between 6 preceding and current row)),
windows_ as (select country, end_date, nonzero, violence_sum from slid where pos >= 7 and (pos - 7) % 3 = 0 and nonzero >= 2)"""


def _windows(spark, d):
    w = timeseries.sliding_windows(timeseries.dense_window(_gaps(spark, d), COLS, 30, AS_OF), ["protest_score", "violence_score"], 7, 3, 2)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x["violence_score"])
    return w.select("country", "end_date", "nonzero", F.round(total + 1e-9, 6).alias("violence_sum"))


@query("w11_sliding_windows", with_sql("select * from windows_", GAPS, DENSE("gaps", 30), SLIDE))
def sliding_windows(spark, d):
    return _windows(spark, d)


PAIRS = "snaps as (select country, feature_date as snapshot_date, violence_score as v, dense_rank() over (order by feature_date) as i from gaps)"
AT = lambda o: f"coalesce((select max(v) from snaps s where s.country = g.country and s.i = g.step + ({o})), 0)"


@query("w12_context_target_pairs", with_sql(f"""select * from (select country, step::int as step, {', '.join(f'{AT(k - 5)} as c{k + 1}' for k in range(6))}, {', '.join(f'{AT(k)} as t{k}' for k in range(1, 5))}
  from (select c.country, x.i as step from (select distinct country from snaps) c, (select distinct i from snaps) x) g
  where step >= 6 and step <= (select max(i) from snaps) - 4)
  where {' + '.join(f'(c{k} <> 0)::int' for k in range(1, 7))} >= 2 and {' + '.join(f'(t{k} <> 0)::int' for k in range(1, 5))} >= 1""", GAPS, PAIRS))
def context_target_pairs(spark, d):
    s = _gaps(spark, d).withColumnRenamed("feature_date", "snapshot_date")
    return timeseries.context_target_pairs(s, "violence_score")


@query("w13_split_by_index", with_sql("""select country, feature_date, case when i <= floor(n * 0.7 + 1e-9) then 'train' when i <= floor(n * 0.85 + 1e-9) then 'val' else 'test' end as split
  from (select country, feature_date, dense_rank() over (order by feature_date) as i, (select count(distinct feature_date) from gaps) as n from gaps)""", GAPS))
def split_by_index(spark, d):
    return timeseries.split_by_index(_gaps(spark, d).select("country", "feature_date"), "feature_date")


@query("w13_split_by_dates", with_sql("select country, feature_date, case when feature_date <= date '2024-01-18' then 'train' when feature_date <= date '2024-01-24' then 'val' else 'test' end as split from gaps", GAPS))
def split_by_dates(spark, d):
    return timeseries.split_by_dates(_gaps(spark, d).select("country", "feature_date"), "feature_date", "2024-01-18", "2024-01-24")


@query("w13_last_share_per_key", with_sql("select country, feature_date from (select *, row_number() over (partition by country order by feature_date) as i, count(*) over (partition by country) as n from gaps) where i > floor(n * 0.8 + 1e-9)", GAPS))
def last_share_per_key(spark, d):
    return timeseries.last_share_per_key(_gaps(spark, d).select("country", "feature_date"), "country", "feature_date")


@query("w14_restride", with_sql("select country, end_date, nonzero, violence_sum from (select *, min(end_date) over (partition by country) as f from windows_) where date_diff('day', f, end_date) % 6 = 0", GAPS, DENSE("gaps", 30), SLIDE))
def restride(spark, d):
    return timeseries.restride(_windows(spark, d), 6)


FOLDS = """folds as (select r.country, r.feature_date as pivot_date, r.risk_score as origin_risk, (i - 14)::int as fold from risk r join (select feature_date, row_number() over (order by feature_date) as i from (select distinct feature_date from risk)) d using (feature_date)
  where i > 14 and country in (select country from risk group by 1 having count(*) >= greatest(14, (select count(distinct feature_date) from risk) / 2)))"""


def _folds(spark, d):
    return timeseries.walk_forward_folds(risk(spark, d), 14)


@query("w15_walk_forward_folds", with_sql("select * from folds", FOLDS))
def walk_forward_folds(spark, d):
    return _folds(spark, d)


@query("w16_active_countries", with_sql("select distinct country from gaps where feature_date between date '2024-01-28' - 1 and date '2024-01-28'", GAPS))
def active_countries(spark, d):
    return timeseries.active_countries(_gaps(spark, d), "2024-01-28", 1, 3)


@query("w17_sampled_grid", with_sql("""select g.country, g.feature_date, coalesce(violence_score, 0) as violence_score from (select country, unnest(generate_series(min(feature_date), (select max(feature_date) from gaps), interval 5 days))::date as feature_date from gaps group by country) g
  left join gaps using (country, feature_date)""", GAPS))
def sampled_grid(spark, d):
    return timeseries.sampled_grid(_gaps(spark, d), ["violence_score"], 5)


@query("l5_last_dates", with_sql("select distinct feature_date from gaps order by 1 desc limit 7", GAPS))
def last_dates(spark, d):
    return timeseries.last_dates(_gaps(spark, d), "feature_date", 7)


# --- scores and forecasts

SCORED = """scored_c as (select *, round(least(greatest(0.4 * instability + 0.3 * war + 0.2 * terrorism + 0.1 * financial, 0), 1) + 1e-9, 6) as risk_score from (
  select country, round(least(0.6 * violence_score + 0.4 * protest_score, 1) + 1e-9, 6) as instability, round(least(0.7 * violence_score + 0.3 * diplomatic_stress, 1) + 1e-9, 6) as war,
  round(least(1.2 * terrorism_score, 1) + 1e-9, 6) as terrorism, round(least(1.1 * economic_stress, 1) + 1e-9, 6) as financial, round(0.6 * coverage + 1e-9, 6) as confidence from tail_))"""


def _scores(spark, d):
    return scoring.score_countries(daily(spark, d), 14, 10, AS_OF)


@query("f1_score_countries", with_sql("select * from scored_c", DENSE("features"), TAIL(10), SCORED))
def score_countries(spark, d):
    return _scores(spark, d)


@query("f2_f4_snapshot_risk", with_sql("select country, feature_date, instability, war, terrorism, financial, risk_score from risk"))
def snapshot_risk(spark, d):
    return risk(spark, d).select("country", "feature_date", "instability", "war", "terrorism", "financial", "risk_score")


U = lambda x: f"round(least(greatest({x}, 0), 1) + 1e-9, 6)"


@query("f3_proxy_labels", with_sql(f"""select country, {U('0.4 * protest + 0.3 * violence + 0.2 * diplo + 0.1 * (1 - goldstein_norm)')} as instability, {U('0.5 * violence + 0.3 * diplo + 0.2 * (1 - goldstein_norm)')} as war,
  {U('0.7 * terror + 0.2 * violence + 0.1 * tone_neg')} as terrorism, {U('0.7 * least(2.5 * econ, 1) + 0.2 * tone_neg + 0.1 * (1 - goldstein_norm)')} as financial from (
  select country, {', '.join(f'round(avg({c}) + 1e-9, 6) as {c}' for c in features.WEIGHTED)} from weighted where event_date > date '{AS_OF}' - 5 group by 1)""", WEIGHTED))
def proxy_labels(spark, d):
    w = _weighted(spark, d).filter(F.col("event_date") > F.date_sub(F.lit(AS_OF).cast("date"), 5))
    return scoring.proxy_labels_from_window(w.groupBy("country").agg(*[F.round(F.avg(c) + 1e-9, 6).alias(c) for c in features.WEIGHTED]))


FCAST = f"""fc as (select country, horizon_step, horizon_days, {U('base + slope * horizon_days * 0.5')} as risk_score from (select country, slope,
  least(greatest(0.4 * least(0.5 * violence_score + 0.5 * protest_score, 1) + 0.3 * least(0.4 * violence_score + 0.4 * diplomatic_stress, 1) + 0.2 * least(1.2 * terrorism_score, 1) + 0.1 * least(0.7 * economic_stress + 0.3 * avg_sentiment, 1), 0), 1) as base
  from tail_ join slope_ using (country)), (select unnest([1, 2, 3, 4])::int as horizon_step, unnest([14, 28, 42, 56])::int as horizon_days)),
forecasts as (select *, {U('risk_score - 0.08')} as lower_bound, {U('risk_score + 0.08')} as upper_bound, 0.4::double as confidence, 0.05::double as variance from fc)"""
FC = (DENSE("features"), TAIL(10), SLOPE(10), FCAST)


def _forecasts(spark, d):
    return scoring.forecast_trend(daily(spark, d), seq_len=14, last=10, as_of=AS_OF)


@query("f5_forecast_trend", with_sql("select * from forecasts", *FC))
def forecast_trend(spark, d):
    return _forecasts(spark, d)


PRED = f"""preds as (select *, pivot_date + horizon_days as target_date, origin_risk as predicted, {U('origin_risk - 0.08')} as lower, {U('origin_risk + 0.08')} as upper from folds, (select unnest([7, 14])::int as horizon_days)),
scored as (select p.*, r.risk_score as actual, {TIER.format('origin_risk')} as tier, round(abs(r.risk_score - predicted) + 1e-9, 6) as residual from preds p left join risk r on r.country = p.country and r.feature_date = p.target_date),
done as (select *, abs(actual - predicted) as e, abs(actual - origin_risk) as b from scored where actual is not null)"""
EVAL = (FOLDS, PRED)


def _scored(spark, d):
    p = scoring.forecast_persistence(_folds(spark, d))
    unit = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) + 1e-9, 6)
    p = p.withColumns({"lower": unit(F.col("predicted") - 0.08), "upper": unit(F.col("predicted") + 0.08)})
    return evaluate.actuals_at_horizon(p, risk(spark, d))


@query("f6_j8_predictions_with_actuals", with_sql("select country, pivot_date, horizon_days, target_date, predicted, actual from scored", *EVAL))
def predictions_with_actuals(spark, d):
    return _scored(spark, d).select("country", "pivot_date", "horizon_days", "target_date", "predicted", "actual")


SK = "case when avg(b) = 0 then 0 else (avg(b) - avg(e)) / avg(b) end"
RD = lambda x, n=4: f"round({x} + 1e-9, {n})"


@query("g22_horizon_metrics", with_sql(f"""select horizon_days, count(*) as n, {RD('avg(e)')} as mae, {RD('sqrt(avg(e * e))')} as rmse, {RD('100 * avg(e / actual) filter (actual > 0.01)', 2)} as mape,
  {RD('avg(case when sign(actual - origin_risk) = sign(predicted - origin_risk) then 1.0::double else 0 end)')} as directional_accuracy, {RD('avg(case when actual between lower and upper then 1.0::double else 0 end)')} as coverage, {RD(SK)} as skill from done group by 1""", *EVAL))
def horizon_metrics(spark, d):
    return evaluate.horizon_metrics(_scored(spark, d))


@query("g23_tier_metrics", with_sql(f"select tier, count(*) as n, {RD('avg(e)')} as mae, {RD('sqrt(avg(e * e))')} as rmse from done group by 1", *EVAL))
def tier_metrics(spark, d):
    return evaluate.tier_metrics(_scored(spark, d))


@query("g24_overall_metrics", with_sql(f"select count(*) as predictions, count(distinct country) as countries, count(distinct pivot_date) as folds, {RD('avg(e)')} as mae, {RD('sqrt(avg(e * e))')} as rmse, {RD(SK)} as skill from done", *EVAL))
def overall_metrics(spark, d):
    return evaluate.overall_metrics(_scored(spark, d))


@query("f12_backtest_fold_log", with_sql(f"select country, pivot_date, horizon_days, target_date, predicted, actual, {RD('e', 6)} as abs_error from done", *EVAL))
def backtest_fold_log(spark, d):
    return evaluate.fold_log(_scored(spark, d))


QU = """qu as (select 'global' as level, null::int as horizon_days, null::varchar as tier, count(*) as n, list(residual order by residual)[least(ceil((count(*) + 1) * 0.8 - 1e-9), count(*))::int] as q from done
  union all select 'horizon', horizon_days, null, count(*), list(residual order by residual)[least(ceil((count(*) + 1) * 0.8 - 1e-9), count(*))::int] from done group by 2
  union all select 'tier', horizon_days, tier, count(*), list(residual order by residual)[least(ceil((count(*) + 1) * 0.8 - 1e-9), count(*))::int] from done group by 2, 3 having count(*) >= 30)"""
CAL = f"""cal as (select s.* exclude (lower, upper), coalesce(t.q, h.q, g.q) as half_width, {RD('greatest(predicted - coalesce(t.q, h.q, g.q), 0)', 6)} as lower, {RD('least(predicted + coalesce(t.q, h.q, g.q), 1)', 6)} as upper from scored s
  left join qu t on t.level = 'tier' and t.horizon_days = s.horizon_days and t.tier = s.tier left join qu h on h.level = 'horizon' and h.horizon_days = s.horizon_days join qu g on g.level = 'global')"""


@query("g25_conformal_quantiles", with_sql("select * from qu", *EVAL, QU))
def conformal_quantiles(spark, d):
    return evaluate.conformal_quantiles(_scored(spark, d))


def _calibrated(spark, d):
    s = _scored(spark, d)
    return evaluate.calibrated(s, evaluate.conformal_quantiles(s))


@query("j10_f7_calibrated_forecast", with_sql("select country, pivot_date, horizon_days, predicted, half_width, lower, upper from cal", *EVAL, QU, CAL))
def calibrated_forecast(spark, d):
    return _calibrated(spark, d).select("country", "pivot_date", "horizon_days", "predicted", "half_width", "lower", "upper")


@query("g26_coverage_report", with_sql(f"select horizon_days, tier, count(*) as n, {RD('avg(case when actual between lower and upper then 1.0::double else 0 end)')} as coverage, {RD('avg(upper - lower)')} as mean_width from cal where actual is not null group by grouping sets ((), (horizon_days), (tier))", *EVAL, QU, CAL))
def coverage_report(spark, d):
    return evaluate.coverage_report(_calibrated(spark, d))


@query("g27_raw_coverage", with_sql(f"select {RD('avg(case when actual between lower and upper then 1.0::double else 0 end)')} as coverage from done", *EVAL))
def raw_coverage(spark, d):
    return evaluate.raw_coverage(_scored(spark, d))


@query("g28_ensemble_interval", with_sql(f"""select country, {RD('m', 6)} as mean, {RD('s * s', 6)} as variance, {U('1 - s * s')} as confidence, {U('m - 1.28 * s')} as lower, {U('m + 1.28 * s')} as upper
  from (select country, avg(risk_score) as m, coalesce(stddev_samp(risk_score), 0) as s from risk group by 1)"""))
def ensemble_interval(spark, d):
    return evaluate.ensemble_interval(risk(spark, d).select("country", F.col("risk_score").alias("value")), ["country"])


TASKROWS = "rows_ as (" + " union all ".join(f"select '{t}' as task, country, feature_date, {t}_label as label, {t} as score, {t} * 0.8 + 0.2 * avg_sentiment as confidence from labels_ join risk on risk.country = labels_.country and risk.feature_date = labels_.label_date".replace("country, feature_date", "risk.country, feature_date") for t in labels.TASKS) + ")"
TR = (LSTAT, LABELS, TASKROWS)


def _task_rows(spark, d):
    j = labels.multitask_labels(facts(spark, d)).withColumnRenamed("label_date", "feature_date").join(risk(spark, d), ["country", "feature_date"])
    t = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"{t}_label").alias("label"), F.col(t).alias("score"), (F.col(t) * 0.8 + 0.2 * F.col("avg_sentiment")).alias("confidence")) for t in labels.TASKS])).alias("t")
    return j.select("country", "feature_date", t).select("country", "feature_date", "t.*")


@query("g29_regression_metrics", with_sql(f"select task, count(*) as n, {RD('avg(e)')} as mae, {RD('avg(e * e)')} as mse, {RD('avg(b)')} as baseline_mae, {RD(SK)} as skill from (select *, abs(label - score) as e, abs(label - avg(label) over (partition by task)) as b from rows_) group by 1", *TR))
def regression_metrics(spark, d):
    return evaluate.regression_metrics(_task_rows(spark, d))


QUAL = "qual as (select 'quality' as task, l.quality::double as label, round(least(d.n_chars / 4000, 1), 2) as score from labels l join documents d using (doc_id))"


@query("g30_ranked_metrics", with_sql(f"""select 'quality' as task, {RD('sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))')} as auc_roc, {RD('sum(pos * tp / (tp + fp)) / sum(pos)')} as auc_pr,
  {RD('2 * sum(pos) filter (score >= 0.5) / (sum(pos + neg) filter (score >= 0.5) + sum(pos))')} as f1 from (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp
  from (select score, count(*) filter (label >= 0.5)::double as pos, count(*) filter (label < 0.5)::double as neg from qual group by 1))""", QUAL))
def ranked_metrics(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.ranked_metrics(j.select(F.lit("quality").alias("task"), F.col("quality").cast("double").alias("label"), F.round(F.least(F.col("n_chars") / 4000, F.lit(1.0)), 2).alias("score")))


@query("g31_ece", with_sql(f"select {RD('sum(n * gap) / (select count(*) from rows_)')} as ece from (select count(*) as n, abs(avg(confidence) - avg(case when abs(label - score) < 0.1 then 1.0::double else 0 end)) as gap from rows_ where confidence < 1 group by floor(confidence * 10 + 1e-12))", *TR))
def ece(spark, d):
    return evaluate.ece(_task_rows(spark, d))


@query("g32_error_coverage", with_sql(f"select task, {RD('avg(case when abs(label - score) <= 0.1 then 1.0::double else 0 end)')} as within_10, {RD('avg(case when abs(label - score) <= 0.2 then 1.0::double else 0 end)')} as within_20, {RD('avg(confidence)')} as mean_confidence from rows_ group by 1", *TR))
def error_coverage(spark, d):
    return evaluate.error_coverage(_task_rows(spark, d))


LV = lambda c: f"case when {c} >= 0.75 then 3 when {c} >= 0.5 then 2 when {c} >= 0.25 then 1 else 0 end"


@query("g33_level_agreement", with_sql(f"select task, {RD(f'avg(case when {LV('label')} = {LV('score')} then 1.0::double else 0 end)')} as level_accuracy, {RD('corr(label, score)')} as pearson_r from rows_ group by 1", *TR))
def level_agreement(spark, d):
    return evaluate.level_agreement(_task_rows(spark, d))


@query("g34_horizon_weighted_mse", with_sql(f"select task, {RD('sum(w * (label - score) ** 2) / sum(w)', 6)} as weighted_mse, {RD('avg((label - score) ** 2)', 6)} as mse from (select *, greatest(0.4, 1 - 0.2 * (day(feature_date) % 4)) as w from rows_) group by 1", *TR))
def horizon_weighted_mse(spark, d):
    return evaluate.horizon_weighted_mse(_task_rows(spark, d).withColumn("step", F.dayofmonth("feature_date") % 4))


# --- network

NORM_ADJ = """both_ as (select src, dst, max(weight) as weight from (select country_a as src, country_b as dst, weight from top_edges where weight >= 0.3 union all select country_b, country_a, weight from top_edges where weight >= 0.3)
  where src in (select country from latest) and dst in (select country from latest) group by 1, 2
  union all select country, country, 1.0 from latest),
nadj as (select src, dst, weight / sum(weight) over (partition by src) as w from both_),
enr as (select src as country, round(sum(w * risk_score) + 1e-9, 6) as n_risk_score from nadj join latest on latest.country = dst group by 1),
amp as (select l.country, l.risk_score, n_risk_score as imported_risk, round(coalesce(n_risk_score - l.risk_score, 0) + 1e-9, 6) as amplification from latest l left join enr e on e.country = l.country),
adjusted as (select *, round(least(greatest(risk_score + 0.15 * amplification, 0), 1) + 1e-9, 6) as adjusted_risk from amp)"""
NETWORK = (*NET, LATEST, NORM_ADJ)


def _latest(spark, d):
    return timeseries.latest_country_risk(risk(spark, d).select("country", "feature_date", "risk_score"))


def _adjacency(spark, d, *days):
    return network.normalised_adjacency(_edges(spark, d, *days), _latest(spark, d), 0.3)


def _adjusted(spark, d, *days):
    n = _latest(spark, d)
    return network.network_adjusted_risk(n, network.neighbour_enrichment(_adjacency(spark, d, *days), n, ["risk_score"]))


@query("n1_normalised_adjacency", with_sql("select src, dst, round(w + 1e-9, 6) as w from nadj", *NETWORK))
def normalised_adjacency(spark, d):
    return _adjacency(spark, d).select("src", "dst", F.round(F.col("w") + 1e-9, 6).alias("w"))


@query("n2_neighbour_enrichment", with_sql("select src as country, round(sum(w * h1) + 1e-9, 6) as n_risk_score from nadj join (select src as s, sum(w * risk_score) as h1 from nadj join latest on latest.country = dst group by 1) on s = dst group by 1", *NETWORK))
def neighbour_enrichment(spark, d):
    return network.neighbour_enrichment(_adjacency(spark, d), _latest(spark, d), ["risk_score"], hops=2)


@query("n3_network_adjusted_risk", with_sql("select * from adjusted", *NETWORK))
def network_adjusted_risk(spark, d):
    return _adjusted(spark, d)


INF = "inf as (select distinct * from (select country_b as neighbor, weight from top_edges where country_a = 'NATION_3' union all select country_a, weight from top_edges where country_b = 'NATION_3'))"


@query("n4_top_influencers", with_sql("select * from inf order by weight desc, neighbor limit 10", *NET, INF))
def top_influencers(spark, d):
    return network.top_influencers(_edges(spark, d), "NATION_3")


@query("j12_ego_network", with_sql("select neighbor, weight, coalesce(risk_score, 0.3) as risk_score from inf left join latest on country = neighbor", *NET, LATEST, INF))
def ego_network(spark, d):
    return network.ego_network(_edges(spark, d), _latest(spark, d), "NATION_3")


NAMES = "names as (select n_name as code, 'Land ' || n_nationkey as name from nation where n_nationkey % 2 = 0)"


def _names(spark, d):
    return table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("code"), F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("name"))


def _dated(df):
    return df.withColumn("computed_date", F.lit(AS_OF).cast("date"))


@query("n5_j4_network_edges", with_sql("select country_a, country_b, weight, coalesce(a.name, country_a) as name_a, coalesce(b.name, country_b) as name_b from top_edges left join names a on a.code = country_a left join names b on b.code = country_b where weight >= 0.4", *NET, NAMES))
def network_edges(spark, d):
    return api.network_edges(_dated(_edges(spark, d)), _names(spark, d), 0.4)


@query("j4_network_nodes", with_sql(f"select country, amplification, risk_score, {TIER.format('risk_score')} as tier from adjusted", *NETWORK))
def network_nodes(spark, d):
    return api.network_nodes(_dated(_adjusted(spark, d)).drop("risk_score"), risk(spark, d))


@query("g37_graph_stats", with_sql("""select count(*) as nodes, (sum(deg) / 2)::bigint as edges, count(*) filter (deg = 0) as isolated, round(avg(deg) + 1e-9, 6) as mean_degree, max(deg) as max_degree,
  round(2.0::double * (sum(deg) / 2) / (count(*) * (count(*) - 1)) + 1e-9, 6) as density from (select country, count(x) as deg from latest left join (select country_a as x from top_edges where weight >= 0.4 union all select country_b from top_edges where weight >= 0.4) on x = country group by 1)""", *NETWORK))
def graph_stats(spark, d):
    return network.graph_stats(_edges(spark, d).filter("weight >= 0.4"), _latest(spark, d))


@query("g42_network_kpis", with_sql("select country, amplification, (select count(*) from adjusted) as n_nodes, (select round(avg(amplification) + 1e-9, 6) from adjusted) as mean_amplification, (select count(*) from top_edges) as n_edges from adjusted order by amplification desc, country limit 10", *NETWORK))
def network_kpis(spark, d):
    return network.network_kpis(_edges(spark, d), _adjusted(spark, d))


@query("g35_ab_compare", with_sql(f"""select horizon_days, count(*) as n, {RD('avg(abs(actual - base))')} as mae_base, {RD('avg(abs(actual - adjusted))')} as mae_adjusted,
  {RD('case when avg(abs(actual - base)) = 0 then 0 else (avg(abs(actual - base)) - avg(abs(actual - adjusted))) / avg(abs(actual - base)) end')} as skill, {RD('corr(base, actual)')} as r_base, {RD('corr(adjusted, actual)')} as r_adjusted
  from (select horizon_days, predicted as base, round(0.9 * predicted + 0.1 * m + 1e-9, 6) as adjusted, actual from done join (select pivot_date, round(avg(origin_risk) + 1e-9, 6) as m from folds group by 1) using (pivot_date)) group by 1""", *EVAL))
def ab_compare(spark, d):
    mean = _folds(spark, d).groupBy("pivot_date").agg(F.round(F.avg("origin_risk") + 1e-9, 6).alias("m"))
    s = _scored(spark, d).join(mean, "pivot_date")
    return evaluate.ab_compare(s.select("horizon_days", F.col("predicted").alias("base"), F.round(0.9 * F.col("predicted") + 0.1 * F.col("m") + 1e-9, 6).alias("adjusted"), "actual"))


@query("g36_distribution_stats", with_sql("select round(avg(risk_score) + 1e-9, 6) as mean, round(stddev_pop(risk_score) + 1e-9, 6) as std, min(risk_score) as min, round(quantile_cont(risk_score, 0.25) + 1e-9, 6) as p25, round(quantile_cont(risk_score, 0.5) + 1e-9, 6) as p50, round(quantile_cont(risk_score, 0.75) + 1e-9, 6) as p75, max(risk_score) as max from risk"))
def distribution_stats(spark, d):
    return order_stats.distribution_stats(risk(spark, d), "risk_score")


@query("g36_extremes", with_sql("select country, risk_score, 'top' as \"end\" from (select * from latest order by risk_score desc, country limit 5) union all select country, risk_score, 'bottom' from (select * from latest order by risk_score, country limit 5)", LATEST))
def extremes(spark, d):
    return evaluate.extremes(_latest(spark, d), "country", "risk_score")


# --- attribution and fitted models

WEIGHTS = {"protest_score": 0.3, "violence_score": 0.5, "economic_stress": 0.2}


@query("f10_attributions", with_sql("select *, row_number() over (partition by country order by magnitude desc, feature)::int as rank from att", "att as (" + " union all ".join(f"select country, '{f}' as feature, round(sum({w} * ({f} - 0.1)) + 1e-9, 6) as contribution, round(sum(abs({w} * ({f} - 0.1))) + 1e-9, 6) as magnitude from features group by 1" for f, w in WEIGHTS.items()) + ")"))
def attributions(spark, d):
    return scoring.attribute_features(daily(spark, d), WEIGHTS, dict.fromkeys(WEIGHTS, 0.1))


#: A tree over two scores: its leaves, and the same as SQL.
TREE = [
    attribution.Leaf(0.10, {"violence_score": (-math.inf, 0.3), "protest_score": (-math.inf, 0.05)}), attribution.Leaf(0.25, {"violence_score": (-math.inf, 0.3), "protest_score": (0.05, math.inf)}),
    attribution.Leaf(0.40, {"violence_score": (0.3, math.inf), "protest_score": (-math.inf, 0.1)}), attribution.Leaf(0.80, {"violence_score": (0.3, math.inf), "protest_score": (0.1, math.inf)}),
]
TREE_SQL = lambda v, p: f"case when {v} <= 0.3 then case when {p} <= 0.05 then 0.1 else 0.25 end else case when {p} <= 0.1 then 0.4 else 0.8 end end::double"
SHAP = f"""shap as (select country, 'violence_score' as feature, 0.5 * (({TREE_SQL('violence_score', 0)} - {TREE_SQL(0, 0)}) + ({TREE_SQL('violence_score', 'protest_score')} - {TREE_SQL(0, 'protest_score')})) as c from features
  union all select country, 'protest_score', 0.5 * (({TREE_SQL(0, 'protest_score')} - {TREE_SQL(0, 0)}) + ({TREE_SQL('violence_score', 'protest_score')} - {TREE_SQL('violence_score', 0)})) from features)"""


@query("f10_tree_attributions", with_sql("select *, row_number() over (partition by country order by magnitude desc, feature) as rank from (select country, feature, round(sum(c) + 1e-9, 6) as contribution, round(sum(abs(c)) + 1e-9, 6) as magnitude from shap group by 1, 2)", SHAP))
def tree_attributions(spark, d):
    return attribution.attribute_trees(daily(spark, d), TREE, ["violence_score", "protest_score"])


@query("f10_fitted_tree_attributions")
def fitted_tree_attributions(spark, d):
    """Of a boosted-tree scorer fitted on the days before the cut; against all subsets in the tests."""
    rows = labels.multitask_labels(facts(spark, d)).withColumnRenamed("label_date", "feature_date").join(daily(spark, d), ["country", "feature_date"])
    split = _kept(timeseries.split_by_dates(rows, "feature_date", "2024-01-18", "2024-01-24"))
    model = scoring.fit_multitask_scorer(split.filter("split = 'train'"), COLS, ["war_label"])["war_label"].stages[-1]
    return attribution.attribute_trees(split.filter("split <> 'train'"), attribution.leaves(model, COLS), COLS)


WALK = """steps_ as (select country, feature_date, risk_score, dense_rank() over (order by feature_date) as step from risk),
pairs_ as (select s.country, s.step, s.feature_date, s.risk_score as x, h.h, t.risk_score as y from steps_ s cross join (values (1), (3), (7)) h(h) left join steps_ t on t.country = s.country and t.step = s.step + h.h),
dates_ as (select distinct step, feature_date from steps_),"""
WALKED = WALK + """
fits as (select p.step, s.h, regr_slope(s.y, s.x) as b, regr_intercept(s.y, s.x) as a from dates_ p join pairs_ s on s.step + s.h <= p.step where s.y is not null group by 1, 2 having count(*) > 2),
walked as (select country, p.feature_date as pivot_date, p.step::int as fold, p.x as origin_risk, h as horizon, d.feature_date as target_date, round(least(greatest(coalesce(a + b * p.x, p.x), 0), 1) + 1e-9, 6) as predicted, p.y as actual
  from pairs_ p join fits using (step, h) left join dates_ d on d.step = p.step + h where p.step > 14)"""


def _snapshots(spark, d):
    return risk(spark, d).withColumnRenamed("feature_date", "snapshot_date")


@query("f12_walk_forward_fitted", with_sql("select * from walked", WALKED))
def walk_forward_fitted(spark, d):
    return backtest.walk_forward(_snapshots(spark, d), "risk_score", 1, (1, 3, 7), 14, 0.0)


@query("f12_walk_forward_metrics", with_sql("""select horizon, count(*) as n, round(avg(abs(actual - predicted)) + 1e-9, 4) as mae, round(sqrt(avg((actual - predicted) * (actual - predicted))) + 1e-9, 4) as rmse,
  round(case when avg(abs(actual - origin_risk)) = 0 then 0 else 1 - avg(abs(actual - predicted)) / avg(abs(actual - origin_risk)) end + 1e-9, 4) as skill from walked where actual is not null group by 1""", WALKED))
def walk_forward_metrics(spark, d):
    scored = walk_forward_fitted(spark, d).withColumn("horizon_days", F.col("horizon")).withColumns({"lower": F.lit(0.0), "upper": F.lit(1.0)})
    return evaluate.horizon_metrics(scored).select(F.col("horizon_days").alias("horizon"), "n", "mae", "rmse", "skill")


@query("f12_walk_forward_contexts")
def walk_forward_contexts(spark, d):
    """Six snapshots of context; against a refit of each fold in the tests."""
    return backtest.walk_forward(_snapshots(spark, d), "risk_score", 6, (1, 2, 3, 4), 14)


BOOT = WALK + """
u as (select p.*, r.r, ('0x' || substr(md5(country || '|' || step || '|' || r.r), 1, 8))::ubigint as u from pairs_ p cross join range(1, 9) r(r)),
wt as (select *, case """ + " ".join(f"when u < {int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32)} then {k}" for k in range(8)) + """ else 8 end as w from u where y is not null),
bsums as (select p.step, s.h, s.r, sum(w) as n, sum(w * x) as sx, sum(w * x * x) as sxx, sum(w * y) as sy, sum(w * x * y) as sxy from dates_ p join wt s on s.step + s.h <= p.step group by 1, 2, 3 having sum(w) > 2),
bfits as (select step, h, r, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n as a from bsums),
boot as (select country, p.feature_date as pivot_date, p.step, p.x as origin_risk, h as horizon, p.y as actual, round(least(greatest(coalesce(a + b * p.x, p.x), 0), 1) + 1e-9, 6) as predicted from pairs_ p join bfits using (step, h) where p.step > 14),
ens as (select country, pivot_date, horizon, actual, avg(predicted) as m, var_samp(predicted) as v from boot group by country, pivot_date, horizon, actual)"""


def _bootstrap(spark, d):
    return backtest.bootstrap_intervals(backtest.bootstrap_forecasts(_snapshots(spark, d), "risk_score", 8, 1, (1, 3, 7), 14, 0.0))


@query("g28_bootstrap_intervals", with_sql("""select country, pivot_date, horizon, actual, round(m + 1e-9, 6) as predicted, round(greatest(m - 1.28 * sqrt(v), 0) + 1e-9, 6) as lower, round(least(m + 1.28 * sqrt(v), 1) + 1e-9, 6) as upper from ens""", BOOT))
def bootstrap_intervals(spark, d):
    return _bootstrap(spark, d).select("country", "pivot_date", "horizon", "actual", "predicted", "lower", "upper")


@query("g26_bootstrap_coverage", with_sql("select horizon, count(*) as n, round(avg(case when actual between round(greatest(m - 1.28 * sqrt(v), 0) + 1e-9, 6) and round(least(m + 1.28 * sqrt(v), 1) + 1e-9, 6) then 1.0::double else 0 end) + 1e-9, 4) as coverage from ens where actual is not null group by 1", BOOT))
def bootstrap_coverage(spark, d):
    report = evaluate.horizon_metrics(_bootstrap(spark, d).withColumn("horizon_days", F.col("horizon")))
    return report.select(F.col("horizon_days").alias("horizon"), "n", "coverage")


@query("f8_fit_forecaster")
def fitted_forecasts(spark, d):
    s = daily(spark, d).withColumnRenamed("feature_date", "snapshot_date")
    split = _kept(timeseries.split_by_index(timeseries.context_target_pairs(s, "violence_score"), "step"))
    train, later = split.filter("split = 'train'"), split.filter("split <> 'train'")
    model = scoring.fit_forecaster(scoring.before_cut(train, train.agg(F.max("step")).scalar()))
    return model.transform(later).select("country", "step", "split", *[F.round(f"p{k}", 4).alias(f"p{k}") for k in range(1, 5)], *[f"t{k}" for k in range(1, 5)])


@query("f9_fit_multitask_scorer")
def fitted_scores(spark, d):
    rows = labels.multitask_labels(facts(spark, d)).withColumnRenamed("label_date", "feature_date").join(daily(spark, d), ["country", "feature_date"])
    split = _kept(timeseries.split_by_dates(rows, "feature_date", "2024-01-18", "2024-01-24"))
    out = split.filter("split <> 'train'")
    for model in scoring.fit_multitask_scorer(split.filter("split = 'train'"), COLS, [f"{t}_label" for t in labels.TASKS]).values():
        out = model.transform(out).drop("x")
    return out.select("country", "feature_date", "split", *[F.round(f"{t}_label_predicted", 4).alias(t) for t in labels.TASKS], *[f"{t}_label" for t in labels.TASKS])


@query("f11_prediction_history", with_sql("select country, feature_date, risk_score from risk where country = 'NATION_5' order by feature_date desc limit 10"))
def prediction_history(spark, d):
    p = risk(spark, d).withColumn("created", F.col("feature_date"))
    return api.prediction_history(p, "NATION_5", 10).select("country", "feature_date", "risk_score")


@query("f11_latest_attributions", with_sql("select country, feature_date as computed_at, protest_score from features join (select country, max(feature_date) as feature_date from features group by 1) using (country, feature_date)"))
def latest_attributions(spark, d):
    return api.latest_attributions(daily(spark, d).select("country", F.col("feature_date").alias("computed_at"), "protest_score"))


# --- read joins

PRE = "pre as (select country, feature_date as created, case when instability > war then 'increasing' else 'decreasing' end as trend, instability, war, 0.7::double as confidence from risk where length(country) % 2 = 0 and feature_date < date '2024-01-25')"
LASTP = "lastp as (select * from (select *, row_number() over (partition by country order by created desc) as n from pre) where n = 1)"


def _predictions(spark, d):
    return risk(spark, d).filter("length(country) % 2 = 0 and feature_date < date '2024-01-25'").select("country", F.col("feature_date").alias("created"), F.when(F.col("instability") > F.col("war"), "increasing").otherwise("decreasing").alias("trend"), "instability", "war", F.lit(0.7).alias("confidence"))


@query("j1_heatmap", with_sql(f"select country, feature_date, coalesce(risk_score, 0) as risk_score, coalesce(trend, 'stable') as trend, case when risk_score is null or risk_score = 0 then 'UNKNOWN' else {TIER.format('risk_score')} end as tier from latest left join lastp using (country)", LATEST, PRE, LASTP))
def heatmap(spark, d):
    return api.heatmap(risk(spark, d), _predictions(spark, d))


@query("j2_node_features", with_sql("select f.country, coalesce(protest_score, 0) as protest_score, coalesce(violence_score, 0) as violence_score, coalesce(instability, 0) as instability, coalesce(war, 0) as war, coalesce(confidence, 0.5) as confidence from (select * from (select *, row_number() over (partition by country order by feature_date desc) as n from features) where n = 1) f left join lastp on lastp.country = f.country", PRE, LASTP))
def node_features(spark, d):
    return api.node_features(daily(spark, d), _predictions(spark, d), ["protest_score", "violence_score"])


@query("j2b_node_features_at", with_sql("select country, violence_score, risk_score as node_war, risk_score as node_financial, 0.5::double as confidence from risk where feature_date = date '2024-01-15'"))
def node_features_at(spark, d):
    return api.node_features_at(risk(spark, d), "2024-01-15", ["violence_score"], ["war", "financial"])


@query("j3_alerts", with_sql(f"select f.country, horizon_step, f.risk_score, coalesce(l.risk_score, 0) as current, round(f.risk_score - coalesce(l.risk_score, 0) + 1e-9, 6) as delta, {TIER.format('f.risk_score')} as tier from forecasts f left join latest l on l.country = f.country where f.risk_score >= 0.1 and round(f.risk_score - coalesce(l.risk_score, 0) + 1e-9, 6) >= -0.2 order by delta desc, 1, 2 limit 50", *FC, LATEST))
def alerts(spark, d):
    f = _forecasts(spark, d).withColumn("forecast_date", F.lit(AS_OF).cast("date"))
    return api.alerts(f, risk(spark, d), 0.1, -0.2)


@query("j9_features_with_labels", with_sql("select f.country, feature_date, violence_score, coalesce(war_label, 0) as war_label, coalesce(terrorism_label, 0) as terrorism_label from features f left join labels_ l on l.country = f.country and l.label_date = f.feature_date - 3", LSTAT, LABELS))
def features_with_labels(spark, d):
    """Labels three days later beside each feature row; the first days have none."""
    later = labels.multitask_labels(facts(spark, d)).withColumn("label_date", F.date_add("label_date", 3))
    return api.features_with_labels(daily(spark, d), later, ["violence_score"], ["war_label", "terrorism_label"])


@query("j11_s8_translation", with_sql("select 'N' || n_nationkey as country, count(*) as n from facts join nation on n_name = action_geo_country where n_nationkey % 4 <> 0 group by 1"))
def translation(spark, d):
    m = table(spark, d, "nation").select(F.col("n_name").alias("iso3"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("fips"))
    return readers.translated(facts(spark, d).withColumnRenamed("action_geo_country", "iso3"), m).groupBy("country").agg(F.count("*").alias("n"))


@query("s8_country_names", with_sql("select n_name as code, coalesce(upper(name), upper(n_name)) as name from nation left join names on code = n_name", NAMES))
def country_names(spark, d):
    return readers.country_names(table(spark, d, "nation").select(F.col("n_name").alias("code")), _names(spark, d))


@query("j13_extended_score", with_sql("""select country, risk_score, coalesce(tf, '') as top_features, coalesce(tn, '') as top_neighbors from scored_c left join (select country, string_agg(feature, ',' order by rank) as tf from (select *, row_number() over (partition by country order by magnitude desc, feature) as rank from att) where rank <= 3 group by 1) using (country)
  left join (select country, string_agg(neighbor, ',' order by r) as tn from (select *, row_number() over (partition by country order by weight desc, neighbor) as r from neigh) where r <= 3 group by 1) using (country)""",
  DENSE("features"), TAIL(10), SCORED, *NET, NEIGH, "att as (" + " union all ".join(f"select country, '{f}' as feature, round(sum(abs({w} * ({f} - 0.1))) + 1e-9, 6) as magnitude from features group by 1" for f, w in WEIGHTS.items()) + ")"))
def extended_score(spark, d):
    return api.extended_score(_scores(spark, d), attributions(spark, d), timeseries.best_neighbors(_edges(spark, d)))


@query("p14_presentation", with_sql("select country, coalesce(name, country) as name, round(coalesce(risk_score, 0) + 1e-9, 3) as risk, round(f1 - risk_score + 1e-9, 6) as change_14, round(f4 - risk_score + 1e-9, 6) as change_56 from latest left join names on code = country left join (select country, max(risk_score) filter (horizon_step = 1) as f1, max(risk_score) filter (horizon_step = 4) as f4 from forecasts group by 1) using (country)", *FC, LATEST, NAMES))
def presentation(spark, d):
    return api.presentation(_latest(spark, d), _names(spark, d), _forecasts(spark, d))


@query("l1_l2_top_countries", with_sql("select country, feature_date, risk_score from latest order by risk_score desc, country limit 20", LATEST))
def top_countries(spark, d):
    return api.top_rows(_latest(spark, d), "risk_score", "country", 20)


# --- text

WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}') and not list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w))"
TERMS = f"""dterms as (select doc_id, term, count(*) as n from (select doc_id, unnest({WORDS.format("coalesce(text, '')")}) as term from documents) group by 1, 2),
vocab as (select term, sum(n)::bigint as total from dterms group by 1 order by total desc, term limit 800),
dv as (select * from dterms where term in (select term from vocab)),
idf as (select term, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from dv group by 1),
wts as (select doc_id, term, n / sum(n) over (partition by doc_id) * idf as w from dv join idf using (term)),
tfidf as (select doc_id, term, w / (sqrt(sum(w * w) over (partition by doc_id)) + 1e-8) as weight from wts)"""


@query("t1_tokenise", with_sql("select doc_id, sum(n)::bigint as n_tokens, count(*) as n_distinct from dterms group by 1", TERMS))
def tokenise(spark, d):
    return text.terms(table(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query("t2_vocabulary", with_sql("select * from vocab", TERMS))
def vocabulary(spark, d):
    return text.build_vocabulary(text.occurrences(table(spark, d, "documents"), "doc_id", "text", "doc_id"))


@query("t3_tfidf_index", with_sql("select doc_id, term, round(weight + 1e-9, 5) as weight from tfidf", TERMS))
def tfidf_index(spark, d):
    return text.tfidf_index(table(spark, d, "documents"), "doc_id").withColumn("weight", F.round(F.col("weight") + 1e-9, 5))


@query("t4_retrieve", with_sql(f"""select item_id, rank, doc_id, similarity from (select item_id, doc_id, similarity, row_number() over (partition by item_id order by similarity desc, doc_id) as rank from (
  select item_id, doc_id, round(sum(q * weight) + 1e-9, 4) as similarity from (select item_id, term, n / (sqrt(sum(n * n) over (partition by item_id)) + 1e-8) as q from (select item_id, term, count(*) as n from (select item_id, unnest({WORDS.format("text")}) as term from benchmark) group by 1, 2)
  where term in (select term from tfidf)) join tfidf using (term) group by 1, 2)) where rank <= 3 and similarity >= 0.05""", TERMS))
def retrieve(spark, d):
    return retrieval.retrieve(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


CORPUS = """corpus_c as (select *, coalesce(avg_goldstein, 0) as g, coalesce(avg_tone, 0) as t from (select * from clusters order by total_mentions desc, country, cluster_date, category limit 500) where event_count >= 3 and total_mentions >= 10),
corpus_l as (select *, case when g < -6 or total_mentions > 5000 then 'CRITICAL' when g < -4 or total_mentions > 2000 then 'HIGH' when g < -2 or total_mentions > 500 then 'ELEVATED' when g < 0 then 'MODERATE' else 'LOW' end as risk_level from corpus_c),
corpus as (select country, cluster_date, category, category || '_' || lower(risk_level) || '_auto' as situation_type, risk_level, 'Recorded ' || case category """ + " ".join(f"when '{k}' then '{v}'" for k, v in text.SITUATIONS.items()) + """ end || ' (' || event_count || ' events, ' || total_mentions || ' mentions) ' ||
  case when g < -5 then 'with extreme negative Goldstein scale scores indicating severe destabilisation' when g < -3 then 'with strongly negative conflict indicators' when g < 0 then 'with moderately negative conflict indicators' else '' end || '. ' ||
  case when t < -10 then 'Media coverage is strongly hostile' when t < -5 then 'Media tone is negative' else '' end || '.' as text, [category, country, lower(risk_level)] as tags from corpus_l)"""


def _corpus(spark, d):
    return text.corpus_from_clusters(features.event_clusters(facts(spark, d)))


@query("t5_corpus_from_clusters", with_sql("select country, cluster_date, category, situation_type, risk_level, text, list_aggregate(tags, 'string_agg', ',') as tags from corpus", CORPUS))
def corpus_from_clusters(spark, d):
    return _corpus(spark, d).withColumn("text", F.regexp_replace("text", r" Average Goldstein scale: \S+$", "")).withColumn("tags", F.array_join("tags", ","))


@query("t6_rebuilt_corpus_terms", with_sql("select risk_level, count(*) as entries from (select risk_level from corpus where category <> 'protest' union all select risk_level from (select * from corpus where category = 'protest' order by cluster_date desc, text limit 20)) group by 1", CORPUS))
def rebuilt_corpus(spark, d):
    c = _corpus(spark, d)
    stored = c.filter("category = 'protest'").withColumn("created", F.col("cluster_date"))
    return text.rebuild_corpus(c.filter("category <> 'protest'"), stored, 20).groupBy("risk_level").agg(F.count("*").alias("entries"))


@query("t7_browse_corpus", with_sql("select country, cluster_date, category, risk_level from (select * from corpus where risk_level = 'LOW' order by text, country, cluster_date limit 1000000)", CORPUS))
def browse_corpus(spark, d):
    return text.browse_corpus(_corpus(spark, d), "LOW", 1_000_000).select("country", "cluster_date", "category", "risk_level")


@query("g17_corpus_stats", with_sql("select risk_level, count(*) as entries from corpus group by 1", CORPUS))
def corpus_stats(spark, d):
    return text.corpus_stats(_corpus(spark, d))


STATE = "state as (select s.country, s.instability, s.war, s.terrorism, s.financial, s.confidence, round(s.risk_score * 3, 6) as risk_score, trend, protest_score, violence_score, diplomatic_stress, economic_stress, terrorism_score from scored_c s join t3 using (country) join tail_ using (country))"
ST = (DENSE("features"), TAIL(10), SCORED, T3, STATE)


def _state(spark, d):
    """Scores, trend and features of each country; the risk is scaled so that several tiers occur."""
    tail = timeseries.tail_means(timeseries.dense_window(daily(spark, d), COLS, 14, AS_OF), COLS, 10).drop("coverage", "avg_sentiment", "avg_goldstein")
    s = _scores(spark, d).withColumn("risk_score", F.round(F.col("risk_score") * 3, 6))
    return s.join(timeseries.trend_3v3(risk(spark, d)), "country").join(tail, "country")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ADV = "adv as (select country, " + TIER.format("risk_score") + " as level, concat_ws(' ', case " + TIER.format("risk_score") + " " + " ".join(f"when '{k}' then {_quote(a)} || country || {_quote(b)}" for k, (a, b) in text.LEVEL_TEXTS.items()) + " end, case trend " + " ".join(f"when '{k}' then {_quote(v)}" for k, v in text.TREND_TEXTS.items()) + " end, " + ", ".join(
    f"case when {h} >= {b}" + "".join(f" and {h} < {b2}" for h2, b2, _ in text.HEAD_TEXTS[:i] if h2 == h) + f" then {_quote(m)} end" for i, (h, b, m) in enumerate(text.HEAD_TEXTS)) + ") as advisory_text from state)"


@query("t8_rule_advisory", with_sql("select country, level, advisory_text from adv", *ST, ADV))
def rule_advisory(spark, d):
    return text.rule_advisory(_state(spark, d)).select("country", "level", "advisory_text")


CANDS = " union all ".join([f"select country, {h}::double as s, {_quote(label)} as l from state where {h} >= 0.4" for h, label in text.HEAD_DRIVERS.items()] + [f"select country, {f}::double, {_quote(label)} from state where {f} >= {b}" for f, (b, label) in text.FEATURE_DRIVERS.items()])
DRV = f"drv as (select s.country, coalesce(string_agg(l, '; ' order by r), {_quote(text.NO_DRIVER)}) as drivers from state s left join (select *, row_number() over (partition by country order by s desc, l desc) as r from ({CANDS})) c on c.country = s.country and r <= 3 group by 1)"


@query("t9_major_drivers", with_sql("select * from drv", *ST, DRV))
def major_drivers(spark, d):
    return text.major_drivers(_state(spark, d)).withColumn("drivers", F.array_join("drivers", "; "))


TRAJ = "traj as (select country, list(risk_score order by horizon_step) as trajectory from forecasts group by 1)"
QRY = f"""qry as (select country, concat_ws(' ', {TIER.format('risk_score')}, trend, replace(drivers, '; ', ' '), case when trajectory[-1] > trajectory[1] + 0.05 then 'deteriorating trajectory escalation' when trajectory[-1] < trajectory[1] - 0.05 then 'improving trajectory de-escalation' end,
  case when risk_score >= 0.8 then 'critical instability conflict crisis' when risk_score >= 0.65 then 'high risk armed conflict protests' end) as query from state join drv using (country) left join traj using (country))"""


@query("t10_j14_retrieval_query", with_sql("select * from qry", *ST, DRV, SLOPE(10), FCAST, TRAJ, QRY))
def retrieval_query(spark, d):
    return text.retrieval_query(_state(spark, d), text.trajectories(_forecasts(spark, d)))


def _augmented(spark, d):
    state, traj = _state(spark, d), text.trajectories(_forecasts(spark, d))
    corpus = text.corpus_text(_corpus(spark, d)).withColumn("entry", F.concat_ws("|", "country", F.col("cluster_date").cast("string"), "category"))
    index = text.tfidf_index(corpus.drop("text").withColumnRenamed("indexed", "text"), "entry")
    hits = text.retrieve(index, text.retrieval_query(state, traj).withColumnRenamed("query", "text"), "entry", "country")
    analogues = hits.join(corpus.select("entry", "risk_level", "situation_type", "text"), "entry")
    return text.augment_advisory(text.rule_advisory(state), analogues, traj)


#: A number with so many decimals as Java writes it: half away from zero, with the sign of what becomes zero.
AS_TEXT = lambda x, n: f"(case when {x} < 0 and round({x}::decimal(18, 6), {n}) = 0 then '-' else '' end || round({x}::decimal(18, 6), {n})::decimal(18, {n})::varchar)"
ENTRIES = f"""entry_ as (select c.country || '|' || c.cluster_date || '|' || c.category as entry, c.risk_level, c.situation_type, c.text || ' Average Goldstein scale: ' || {AS_TEXT('g', 1)} || '.' as text, c.tags
  from corpus c join corpus_l l using (country, cluster_date, category)),
edoc as (select entry, concat_ws(' ', text, list_aggregate(tags, 'string_agg', ' '), replace(situation_type, '_', ' '), risk_level) as indexed from entry_),
eterm as (select entry, term, count(*) as n from (select entry, unnest({WORDS.format("indexed")}) as term from edoc) group by 1, 2),
evocab as (select term from (select term, sum(n) as total from eterm group by 1 order by total desc, term limit 800)),
ev as (select * from eterm where term in (select term from evocab)),
eidf as (select term, ln((1 + (select count(*) from edoc)) / (1 + count(*))) + 1 as idf from ev group by 1),
ew as (select entry, term, n / sum(n) over (partition by entry) * idf as w from ev join eidf using (term)),
eweight as (select entry, term, w / (sqrt(sum(w * w) over (partition by entry)) + 1e-8) as weight from ew),
qterm as (select country, term, n / (sqrt(sum(n * n) over (partition by country)) + 1e-8) as q from (select country, term, count(*) as n from (select country, unnest({WORDS.format("query")}) as term from qry) group by 1, 2) where term in (select term from eweight)),
hit as (select * from (select *, row_number() over (partition by country order by similarity desc, entry) as rank from (select country, entry, round(sum(q * weight) + 1e-9, 4) as similarity from qterm join eweight using (term) group by 1, 2)) where rank <= 2 and similarity >= 0.05),
analog as (select country, string_agg('[' || risk_level || '/' || replace(situation_type, '_', ' ') || '] ' || text, ' — ' order by rank) as said from hit join entry_ using (entry) group by 1),
clause as (select country, case when trajectory[-1] > trajectory[1] + 0.08 then 'Model forecast projects risk escalating to ' || {AS_TEXT('trajectory[-1]', 2)} || ' within ' || 2 * len(trajectory) || ' weeks — heightened monitoring advised.'
  when trajectory[-1] < trajectory[1] - 0.08 then 'Model forecast projects risk moderating to ' || {AS_TEXT('trajectory[-1]', 2)} || ' within ' || 2 * len(trajectory) || ' weeks — conditions may stabilise.'
  else 'Model forecast is stable (' || {AS_TEXT('trajectory[-1]', 2)} || ') over the next ' || 2 * len(trajectory) || ' weeks.' end as ahead from traj),
augmented as (select country, level, concat_ws(' ', advisory_text, 'Historical analogues of similar risk patterns: ' || said, ahead) as advisory_text from adv left join analog using (country) left join clause using (country))"""
AUGMENTED = (*ST, ADV, DRV, SLOPE(10), FCAST, TRAJ, QRY, CORPUS, ENTRIES)


@query("t11_augment_advisory", with_sql("select * from augmented", *AUGMENTED))
def augment_advisory(spark, d):
    return _augmented(spark, d)


@query("j15_advisory_comparison", with_sql("select country, adv.advisory_text as rule_text, augmented.advisory_text as augmented_text from adv join augmented using (country)", *AUGMENTED))
def advisory_comparison(spark, d):
    return api.advisory_comparison(text.rule_advisory(_state(spark, d)), _augmented(spark, d))


@query("v1_vector_topk", with_sql("""select query_id, rank, vec_id, cosine from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from (select q.vec_id as query_id, v.vec_id,
  round(list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))) + 1e-9, 6) as cosine
  from embeddings q join embeddings v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id)) where rank <= 5"""))
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return vector_index.nearest(v, v.filter("vec_id % 50 = 0"))


# --- read endpoints

@query("api_countries", with_sql("select country, coalesce(upper(name), country) as name, max(feature_date) as last_date, count(*) as days from features left join names on code = country group by country, name", NAMES))
def api_countries(spark, d):
    return api.countries(daily(spark, d), _names(spark, d))


@query("api_timeline", with_sql("select country, feature_date, risk_score, protest_score from risk where country = 'NATION_7' and feature_date >= (select max(feature_date) - 10 from risk where country = 'NATION_7')"))
def api_timeline(spark, d):
    return api.timeline(risk(spark, d), "NATION_7", 10).select("country", "feature_date", "risk_score", "protest_score")


@query("api_events", with_sql("select country, cluster_date, category, event_count, total_mentions from clusters where country = 'NATION_7' and cluster_date >= (select max(cluster_date) - 12 from clusters where country = 'NATION_7')"))
def api_events(spark, d):
    return api.country_events(features.event_clusters(facts(spark, d)), "NATION_7", 12).select("country", "cluster_date", "category", "event_count", "total_mentions")


@query("api_labels", with_sql("select country, label_date, instability_label, war_label from labels_ where country = 'NATION_7' and label_date >= (select max(label_date) - 12 from labels_ where country = 'NATION_7')", LSTAT, LABELS))
def api_labels(spark, d):
    return api.country_labels(labels.multitask_labels(facts(spark, d)), "NATION_7", 12).select("country", "label_date", "instability_label", "war_label")


@query("api_cluster_browse", with_sql("select country, cluster_date, category, total_mentions from clusters where country = 'NATION_7' and category in ('military', 'protest') and total_mentions >= 20 and cluster_date >= (select max(cluster_date) - 12 from clusters where country = 'NATION_7')"))
def api_cluster_browse(spark, d):
    return api.browse_clusters(features.event_clusters(facts(spark, d)), ["military", "protest"], 20, "NATION_7", 12).select("country", "cluster_date", "category", "total_mentions")


@query("api_spillover", with_sql("select * from (select case when country_a = 'NATION_7' then country_b else country_a end as neighbor, correlation, cooccurrence, is_adjacent, weight from top_edges where 'NATION_7' in (country_a, country_b)) order by weight desc, neighbor limit 5", *RECENT_NET))
def api_spillover(spark, d):
    return api.country_spillover(_edges(spark, d, *RECENT), "NATION_7")


@query("api_influence", with_sql("select country, imported_risk, amplification, adjusted_risk, (select string_agg(neighbor, ',' order by weight desc, neighbor) from (select * from inf order by weight desc, neighbor limit 5)) as influencers from adjusted where country = 'NATION_3'", *RECENT_NET, LATEST, NORM_ADJ, INF))
def api_influence(spark, d):
    return api.country_influence(_adjusted(spark, d, *RECENT), _edges(spark, d, *RECENT), "NATION_3")


@query("api_forecast", with_sql("select * from forecasts where country = 'NATION_7'", *FC))
def api_forecast(spark, d):
    return api.country_forecast(_forecasts(spark, d), "NATION_7")


@query("api_corpus", with_sql("select risk_level, situation_type, category from (select * from corpus where risk_level = 'MODERATE' order by text, country, cluster_date limit 1000000)", CORPUS))
def api_corpus(spark, d):
    return api.corpus_entries(_corpus(spark, d), "moderate", 1_000_000).select("risk_level", "situation_type", "category")


@query("api_ledger", with_sql("select status, count(*) as files, sum(ev)::bigint as events, (select count(*) from facts) as events_total from (select case when n > 10 then 'pending' when events % 5 = 0 then 'error' else 'done' end as status, case when n > 10 then 0 else events end as ev from (select *, row_number() over (order by file_ts) as n from man)) group by 1", "man as (select event_date::timestamp as file_ts, count(*) as events from facts group by 1)"))
def api_ledger(spark, d):
    return api.ledger_summary(_ledger(spark, d), facts(spark, d)).drop("latest")


@query("api_runs", with_sql("select event_date::varchar as run_id, event_date::varchar as run_date, count(*) as inserted from facts group by 1, 2 order by 2 desc, 1 limit 20"))
def api_runs(spark, d):
    n = sinks.count_per_date(facts(spark, d))
    return api.ingestion_runs(n.select(F.col("event_date").cast("string").alias("run_id"), F.col("event_date").cast("string").alias("run_date"), F.col("n").alias("inserted")))


@query("api_advisory", with_sql("select country, coalesce(upper(name), country) as name, level, confidence, advisory_text from augmented join state using (country) left join names on code = country where country = 'NATION_7'", *AUGMENTED, NAMES))
def api_advisory(spark, d):
    return api.country_advisory(_augmented(spark, d), _state(spark, d), _names(spark, d), "NATION_7")


# --- files

@query("s1_s6_read_events", with_sql("select global_event_id, event_date, quad_class from parsed"))
def read_events(spark, d):
    """Events written as tab-separated lines of all 58 columns and read, parsed and typed again."""
    from tidewatch.operators.clean import parse_events
    from tidewatch.plans.fixtures import raw_events

    out, raw = scratch(spark), raw_events(spark, d)
    lines = raw.select(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("") for c in readers.V1_COLUMNS]).alias("line"))
    sinks.write_lines(lines, out)
    return parse_events(readers.read_events_v1(spark, out)).select("global_event_id", "event_date", "quad_class")


@query("s5_feature_snapshots", with_sql("select country, feature_date as snapshot_date, violence_score as violence, protest_score as protest from features"))
def feature_snapshots(spark, d):
    """One folder a day; even days have numbered columns, odd days named ones."""
    out, f = scratch(spark), daily(spark, d)
    for rest, names in ((0, ("f0", "f1")), (1, ("protest", "violence"))):
        rows = f.filter(F.dayofmonth("feature_date") % 2 == rest).select("country", F.col("protest_score").alias(names[0]), F.col("violence_score").alias(names[1]), F.date_format("feature_date", "yyyyMMdd'_features.parquet'").alias("day"))
        rows.write.mode("append").partitionBy("day").parquet(out)
    return readers.read_feature_snapshots(spark, out).select("country", "snapshot_date", "violence", "protest")


PLACED = ["global_event_id", "event_date", "quad_class", "latitude", "longitude"]


def _lines(spark, d, columns):
    from tidewatch.plans.fixtures import raw_events

    raw = raw_events(spark, d)
    return raw.select(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("") for c in columns]).alias("line"))


@query("s2_read_events_v2", with_sql(f"select {', '.join(PLACED)} from parsed"))
def read_events_v2(spark, d):
    """Events written as lines of all 61 columns and read, parsed and typed again."""
    from tidewatch.operators.clean import parse_events

    out = scratch(spark)
    sinks.write_lines(_lines(spark, d, readers.V2_COLUMNS), out)
    return parse_events(readers.read_events_v2(spark, out)).select(*PLACED)


@query("s3_read_polecat", ORACLE_SQL["g3_polecat_daily_features"])
def read_polecat(spark, d):
    """Typed event files written with a header, read and turned into daily features."""
    out, e = scratch(spark), facts(spark, d)
    kind = {"Event Date": F.date_format("event_date", "yyyy-MM-dd"), "Country": F.col("action_geo_country"), "Event Type": F.expr(KIND), "Quad Code": F.expr(QUAD), "Event Intensity": F.col("goldstein").cast("string")}
    e.select(*[c.alias(n) for n, c in kind.items()]).write.option("header", True).option("sep", "\t").csv(out)
    return features.polecat_daily_features(readers.read_polecat(spark, out).withColumnRenamed("iso3", "country"))


#: Files of at most so many event ids.
FILE_IDS = 500
FILE_STAMP = "strftime(timestamp '2024-01-01' + interval 15 minutes * (arrival % 10000000 // 500), '%Y%m%d%H%M%S')"


def _archives(spark, d):
    """Zip archives of the raw events by id, with names of time stamps 15 minutes apart, and a manifest that lists them."""
    from tidewatch.plans.fixtures import raw_events

    root, listing, raw = scratch(spark), scratch(spark), raw_events(spark, d)
    line = F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("") for c in readers.V2_COLUMNS])
    stamp = F.date_format(F.expr(f"timestamp'2024-01-01' + make_dt_interval(0, 0, 15) * (arrival % 10000000 div {FILE_IDS})"), "yyyyMMddHHmmss")

    def archived(rows):
        import zipfile

        import pandas as pd
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(root)
        files.create_dir(place, recursive=True)
        name, half = f"{rows['stamp'].iloc[0]}.export.CSV", len(rows) // 2
        with files.open_output_stream(f"{place}/{name}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, "\n".join(rows["line"][:half]).encode("latin-1"))
            z.writestr(f"more_{name}", "\n".join(rows["line"][half:]).encode("latin-1"))
        return pd.DataFrame({"value": [f"{len(rows)} hash http://files.example/v2/{name}.zip"]})

    raw.select(stamp.alias("stamp"), line.alias("line")).groupBy("stamp").applyInPandas(archived, "value string").write.text(listing)
    return root, listing


@query("s4_read_archives", with_sql(f"select {', '.join(PLACED)} from parsed"))
def read_archives(spark, d):
    """Zip archives with two members each, read by member, parsed and typed."""
    from tidewatch.operators.clean import parse_events

    return parse_events(readers.events_of_lines(readers.expand_zip_archives(spark, _archives(spark, d)[0]))).select(*PLACED)


@query("k1_append_new_events", with_sql("select global_event_id, event_date from facts"))
def append_new_events(spark, d):
    """Two overlapping batches into an event history."""
    h, e = History(spark, scratch(spark)), facts(spark, d)
    h.append(e.filter("num_mentions < 60"))
    h.append(e.filter("num_mentions >= 40"))
    return h.read().select("global_event_id", "event_date")


@query("k2_upsert", with_sql("select country, feature_date, case when day(feature_date) % 2 = 0 then total_events + 1000 else total_events end as total_events, case when day(feature_date) <= 20 then 0.5::double end as risk_score from features"))
def upsert(spark, d):
    """Three commits to a versioned table by day, compacted and freed of old versions."""
    f, t = daily(spark, d).select("country", "feature_date", "total_events"), VersionedTable(spark, scratch(spark), ["feature_date"])
    t.append(f.filter("day(feature_date) <= 20").withColumn("risk_score", F.lit(0.5)))
    keys = ["country", "feature_date"]
    t.upsert(f.filter("day(feature_date) % 2 = 0").withColumn("total_events", F.col("total_events") + 1000), keys, ["total_events"])
    t.append(f.filter("day(feature_date) > 20 and day(feature_date) % 2 = 1").withColumn("risk_score", F.lit(None).cast("double")))
    t.compact()
    t.vacuum()
    return t.read().select("country", "feature_date", "total_events", "risk_score")


@query("k3_monthly_facts", with_sql("select strftime(event_date, '%Y-%m') as event_month, count(*) as n from facts group by 1"))
def monthly_facts(spark, d):
    out = scratch(spark)
    sinks.write_monthly(facts(spark, d), out)
    return spark.read.parquet(out).groupBy(F.col("event_month").cast("string").alias("event_month")).agg(F.count("*").alias("n"))


MAN = "man as (select 'http://x/' || strftime(event_date, '%Y%m%d') || '000000.export.CSV.zip' as file_url, event_date::timestamp as file_ts, count(*) as events from facts group by 1, 2)"


def _manifest(spark, d):
    e = facts(spark, d).groupBy("event_date").agg(F.count("*").alias("events"))
    return e.select(F.concat(F.lit("http://x/"), F.date_format("event_date", "yyyyMMdd"), F.lit("000000.export.CSV.zip")).alias("file_url"), F.col("event_date").cast("timestamp").alias("file_ts"), "events")


def _ledger(spark, d):
    m = _manifest(spark, d)
    empty = spark.createDataFrame([], "file_url string, file_ts timestamp, status string, events long, error string")
    ledger = sinks.register_files(empty, m)
    done = sinks.next_files(ledger, 10).select("file_url").join(m, "file_url").select("file_url", F.when(F.col("events") % 5 == 0, "error").otherwise("done").alias("status"), "events", F.lit(None).cast("string").alias("error"))
    return sinks.mark_files(ledger, done)


@query("k5_l4_file_ledger", with_sql("select file_url, case when n > 10 then 'pending' when events % 5 = 0 then 'error' else 'done' end as status, case when n > 10 then 0 else events end as events from (select *, row_number() over (order by file_ts) as n from man)", MAN))
def file_ledger(spark, d):
    return _ledger(spark, d).select("file_url", "status", "events")


@query("g16_ledger_status", with_sql("select status, count(*) as files, sum(ev)::bigint as events from (select case when n > 10 then 'pending' when events % 5 = 0 then 'error' else 'done' end as status, case when n > 10 then 0 else events end as ev from (select *, row_number() over (order by file_ts) as n from man)) group by 1", MAN))
def ledger_status(spark, d):
    return sinks.ledger_status(_ledger(spark, d)).drop("latest")


@query("s6_read_manifest", with_sql("select file_url, strftime(file_ts, '%Y-%m-%d') as file_date from man", MAN))
def read_manifest(spark, d):
    out = scratch(spark)
    _manifest(spark, d).select(F.concat_ws(" ", "events", F.md5("file_url"), "file_url").alias("value")).unionByName(_manifest(spark, d).select(F.concat_ws(" ", "events", F.lit("h"), F.lit("http://x/other.gkg.csv.zip")).alias("value"))).write.text(out)
    return readers.read_file_manifest(spark, out).select("file_url", F.date_format("file_ts", "yyyy-MM-dd").alias("file_date"))


@query("k4_g43_run_summary", with_sql("select count(distinct event_date) filter (n % 5 <> 0) as dates_ok, sum(n)::bigint as events_inserted from (select event_date, count(*) as n from facts group by 1)"))
def run_summary(spark, d):
    n = sinks.count_per_date(facts(spark, d))
    return sinks.run_summary(n.select(F.col("event_date").alias("run_date"), F.col("n").alias("inserted"), F.when(F.col("n") % 5 != 0, "success").otherwise("failed").alias("status")))


@query("k4_k8_audit_log", with_sql(f"select run, '{AS_OF}' as run_date, parsed, case when run = 'first' then inserted else 0 end as inserted, skipped, 'success' as status from (select unnest(['first', 'again']) as run), n_", """n_ as (select count(*) filter (global_event_id >= 1 and event_date is not null) as parsed, count(*) filter (not coalesce(global_event_id >= 1 and event_date is not null, false)) as skipped,
  (select count(*) from (select distinct global_event_id, event_date from parsed)) as inserted from typed)"""))
def audit_log(spark, d):
    """The same events ingested twice, with an audit row appended for each run."""
    from tidewatch.operators.clean import parse_counts, parse_events
    from tidewatch.plans.fixtures import raw_events

    out, log, raw = scratch(spark), scratch(spark), raw_events(spark, d)
    counts = parse_counts(raw).first()
    for run in ("first", "again"):
        inserted = sinks.append_new_events(parse_events(raw), out, spark.read.parquet(out) if run == "again" else None)
        sinks.append(sinks.audit_row(spark, run, AS_OF, counts["n_parsed"], inserted, counts["n_skipped"], 0.0, "success"), log)
    return spark.read.parquet(log).select(F.col("run_id").alias("run"), "run_date", "parsed", "inserted", "skipped", "status")


@query("k6_u2_missing_dates", with_sql("select distinct event_date from facts where event_date not in (select event_date from facts where global_event_id % 400 = 0)"))
def missing_dates(spark, d):
    e = facts(spark, d)
    return sinks.missing_dates(e.select("event_date").distinct(), e.filter("global_event_id % 400 = 0"))


@query("k7_s9_json_results", with_sql("select * from qu", *EVAL, QU))
def json_results(spark, d):
    out = scratch(spark)
    sinks.write_json(evaluate.conformal_quantiles(_scored(spark, d)), out)
    return readers.read_results(spark, out, "level string, horizon_days int, tier string, n long, q double")


# --- streams

def _stream(spark, d):
    folder = scratch(spark)
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).alias("country"), F.round("value", 0).alias("value"))
    e = e.unionByName(e.filter("event_id % 10 = 0"))
    e.repartitionByRange("ts").write.parquet(folder)
    return spark.readStream.schema(e.schema).parquet(folder)


EV = "ev as (select event_id, ts, user_id % 25 as country, round(value, 0) as value from events)"


@query("d3_x3_streaming_dedup", with_sql("select country, count(*) as n from ev group by 1", EV))
def streaming_dedup(spark, d):
    rows = jobs.run_to_table(jobs.deduplicated(_stream(spark, d)).select("event_id", "country"), scratch(spark))
    return rows.groupBy("country").agg(F.count("*").alias("n"))


@query("x4_streaming_daily", with_sql("select ts::date as day, country, count(*) as n, sum(value) as total from ev group by 1, 2", EV))
def streaming_daily(spark, d):
    path = scratch(spark)
    stream = jobs.daily_counts(jobs.deduplicated(_stream(spark, d)), watermarked=True)
    jobs.upsert_batches(stream, path, ["day", "country"], scratch(spark)).awaitTermination()
    return VersionedTable(spark, path, ["day"]).read().select("day", "country", "n", "total")


@query("x5_streaming_weekly", with_sql("""select date_trunc('week', ts)::date as week, country, count(*) as n, avg(value) as mean from (select * from ev union all select * from ev where event_id % 10 = 0)
  where date_trunc('week', ts) + interval 7 days <= (select date_trunc('milliseconds', max(ts)) - interval 14 days from ev) group by 1, 2""", EV))
def streaming_weekly(spark, d):
    return jobs.run_to_table(jobs.weekly_aggregate(_stream(spark, d)), scratch(spark))


#: A landing of more events has more files, and its batches take more, in the same measure: no file grows, and there are as many batches.
LANDED_EVENTS = 500_000


@query("x1_x2_streaming_ingest", with_sql("select global_event_id, event_date from parsed where coalesce(action_geo_country, '') <> '' group by 1, 2"))
def streaming_ingest(spark, d):
    """Landed lines in four files, taken two files at a time; so many times both as the events are of ``LANDED_EVENTS``."""
    landed, out = scratch(spark), scratch(spark)
    times = max(1, -(-table(spark, d, "events").count() // LANDED_EVENTS))
    sinks.land_lines(_lines(spark, d, readers.V1_COLUMNS).repartition(4 * times, "line"), landed)
    jobs.ingest(jobs.event_lines(spark, landed, 2 * times), out, scratch(spark), scratch(spark)).awaitTermination()
    return History(spark, out).read().select("global_event_id", "event_date")


PER_ROUND = 8


def _ingested(spark, d, latest_first):
    root, listing = _archives(spark, d)
    job = jobs.ManifestIngest(spark, listing, root, scratch(spark), latest_first=latest_first, per_round=PER_ROUND)
    job.run_all()
    return job


@query("x1_manifest_ingest", with_sql("select global_event_id, event_date from parsed where coalesce(action_geo_country, '') <> '' group by 1, 2"))
def manifest_ingest(spark, d):
    """Archives named by a manifest, taken in rounds until none is pending."""
    return _ingested(spark, d, False).history.read().select("global_event_id", "event_date")


@query("x2_manifest_rounds", with_sql(f"""select 'http://files.example/v2/' || stamp || '.export.CSV.zip' as file_url, ((row_number() over (order by stamp desc) - 1) // {PER_ROUND} + 1)::int as round, 'done' as status, 1 as attempts
  from (select distinct {FILE_STAMP} as stamp from raw)"""))
def manifest_rounds(spark, d):
    """The round in which each file was taken, the latest first, and what the ledger says of it."""
    from tidewatch.sources.manifest import round_files, round_numbers

    job = _ingested(spark, d, True)
    taken = spark.createDataFrame([(u, n) for n in round_numbers(job.rounds) for u in round_files(job.rounds, n)], "file_url string, round int")
    return job.ledger.read().join(taken, "file_url").select("file_url", "round", "status", "attempts")


@query("x6_rows_dropped_late", with_sql("select count(*) as n_late from ev where ts <= (select date_trunc('milliseconds', max(ts)) - interval 3 days from ev)", EV))
def late_rows(spark, d):
    """All events land, then land once more: those behind the watermark are dropped and counted."""
    folder, state, out = scratch(spark), scratch(spark), scratch(spark)
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for _ in range(2):
        e.repartitionByRange("ts").write.mode("append").parquet(folder)
        rows = jobs.deduplicated(spark.readStream.schema(e.schema).parquet(folder))
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.range(1).select(F.lit(jobs.rows_dropped_late(q)).cast("long").alias("n_late"))


LATE_FIRST = "select global_event_id, event_date from parsed where coalesce(action_geo_country, '') <> '' group by 1, 2"


@query("x2_latest_first", with_sql(LATE_FIRST))
def latest_first(spark, d):
    """Files landed in three writes, taken eight at a time, the newest first."""
    landed, out = scratch(spark), scratch(spark)
    for part in range(3):
        sinks.land_lines(_lines(spark, d, readers.V1_COLUMNS).filter(F.pmod(F.xxhash64("line"), F.lit(3)) == part), landed)
    jobs.ingest(jobs.event_lines(spark, landed, 8, latest_first=True), out, scratch(spark), scratch(spark)).awaitTermination()
    return History(spark, out).read().select("global_event_id", "event_date")


LACKING = "between date '2024-01-05' and date '2024-01-12' and day({0}) % 3 <> 0"


@query("x7_backfill_labels", with_sql(f"select * from labels_ where label_date {LACKING.format('label_date')}", LSTAT, LABELS))
def backfilled_labels(spark, d):
    return jobs.backfill_labels(facts(spark, d), daily(spark, d).filter("day(feature_date) % 3 = 0"), "2024-01-05", "2024-01-12")


@query("x7_backfill_clusters", with_sql(f"select * from clusters where cluster_date {LACKING.format('cluster_date')}"))
def backfilled_clusters(spark, d):
    return jobs.backfill_clusters(facts(spark, d), daily(spark, d).filter("day(feature_date) % 3 = 0"), "2024-01-05", "2024-01-12")


ROLLED = """dates_ as (select unnest(generate_series(timestamp '2024-01-16', timestamp '2024-01-30', interval 1 day))::date as as_of),
rc as (select as_of, a.country as country_a, b.country as country_b, count(*) as overlap, corr(a.risk_score, b.risk_score) as c from dates_ join risk a on a.feature_date between as_of - 14 and as_of
  join risk b on a.feature_date = b.feature_date and a.country < b.country group by 1, 2, 3 having count(*) >= 10),
rolled_corr as (select as_of, country_a, country_b, overlap, round(c + 1e-9, 6) as correlation from rc where c is not null and not isnan(c)),
rolled_cooc as (select as_of, least(a, b) as country_a, greatest(a, b) as country_b, sum(n)::bigint as events from (select as_of, actor1_country as a, actor2_country as b, count(*) as n from dates_ join facts on event_date between as_of - 14 and as_of
  where quad_class in (3, 4) and actor2_country is not null and actor1_country <> actor2_country group by 1, 2, 3 having count(*) >= 2) group by 1, 2, 3),
rolled as (select as_of, coalesce(r.country_a, o.country_a) as country_a, coalesce(r.country_b, o.country_b) as country_b, coalesce(correlation, 0) as correlation, coalesce(cooc, 0) as cooc
  from rolled_corr r full join (select *, ln(1 + events) / max(ln(1 + events)) over (partition by as_of) as cooc from rolled_cooc) o using (as_of, country_a, country_b)),
rolled_edges as (select rolled.*, adj.country_a is not null as is_adjacent, 0.5 * abs(correlation) + 0.5 * cooc as base from rolled left join adj using (country_a, country_b)),
rolled_top as (select as_of, country_a, country_b, correlation, round(cooc + 1e-9, 6) as cooccurrence, is_adjacent, round(case when is_adjacent then least(base + 0.15, 1) else base end + 1e-9, 6) as weight from rolled_edges
  qualify row_number() over (partition by as_of order by round(case when is_adjacent then least(base + 0.15, 1) else base end + 1e-9, 6) desc, country_a, country_b) <= 200)"""


@query("j5_rolling_correlations", with_sql("select * from rolled_corr", ROLLED.split(",\nrolled_cooc as")[0]))
def rolling_correlations(spark, d):
    return network.rolling_correlations(risk(spark, d), "2024-01-16", AS_OF, 14, 10)


@query("g18_rolling_cooccurrence", with_sql("select * from rolled_cooc", ROLLED.split(",\nrolled as")[0]))
def rolling_cooccurrence(spark, d):
    return network.rolling_cooccurrence(facts(spark, d), "2024-01-16", AS_OF, 14, 2)


@query("j6_rolling_spillover", with_sql("select * from rolled_top", ADJ, ROLLED))
def rolling_spillover(spark, d):
    f = facts(spark, d)
    c, o = network.rolling_correlations(risk(spark, d), "2024-01-16", AS_OF, 14, 10), network.rolling_cooccurrence(f, "2024-01-16", AS_OF, 14, 2)
    return network.rolling_spillover(c, o, _adjacent(spark, d), 200)


@query("x7_backfill_spillover", with_sql("select * from rolled_top where day(as_of) % 3 <> 0", ADJ, ROLLED.replace("<= 200)", "<= 500)")))
def backfilled_spillover(spark, d):
    done = spark.sql("select explode(sequence(date'2024-01-16', date'2024-01-30')) as as_of").filter("day(as_of) % 3 = 0")
    return jobs.backfill_spillover(facts(spark, d), _adjacent(spark, d), done, "2024-01-16", AS_OF, 14, 10)


@query("x7_backfill", with_sql("select feature_date, country, total_events, violence_score from features where feature_date between date '2024-01-05' and date '2024-01-12' and day(feature_date) % 3 <> 0"))
def backfill(spark, d):
    f = daily(spark, d)
    return jobs.backfill(facts(spark, d), f.filter("day(feature_date) % 3 = 0"), "2024-01-05", "2024-01-12").select("feature_date", "country", "total_events", "violence_score")
