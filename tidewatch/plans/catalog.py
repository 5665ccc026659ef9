"""Every query of the analytics operators, with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import api
from tidewatch.functions.scalar import level_bin, r6, risk_tier, sigmoid
from tidewatch.operators import clean, features, labels, network, scoring, timeseries
from tidewatch.plans.fixtures import AS_OF, facts, raw_events, table, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MIN_DATE = "2024-01-03"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def daily(spark: SparkSession, d: str) -> DataFrame:
    return features.daily_features(facts(spark, d))


def risk(spark: SparkSession, d: str) -> DataFrame:
    return scoring.snapshot_risk(daily(spark, d))


def _typed(raw: DataFrame) -> DataFrame:
    # arrival rides along as one more text column's neighbour
    return clean.typed_events(raw.withColumn("actor1_code", F.col("arrival").cast("string"))).withColumn("arrival", F.col("actor1_code").cast("long"))


TIER = "case when {0} >= 0.8 then 'CRITICAL' when {0} >= 0.65 then 'HIGH' when {0} >= 0.5 then 'ELEVATED' when {0} >= 0.35 then 'MODERATE' else 'LOW' end"


@query("latest_risk_by_country", with_sql(f"select country, feature_date, risk_score, {TIER.format('risk_score')} as tier from (select *, row_number() over (partition by country order by feature_date desc) as n from risk) where n = 1"))
def latest_risk_by_country(spark, d):
    events = clean.first_by_id(facts(spark, d).withColumn("arrival", F.col("global_event_id")))
    r = timeseries.latest_country_risk(scoring.snapshot_risk(features.daily_features(events)))
    return r.select("country", "feature_date", "risk_score", risk_tier(F.col("risk_score")).alias("tier")).orderBy(F.desc("risk_score"), "country")


PARSED = ["global_event_id", "event_date", "actor1_country", "actor2_country", "action_geo_country", "event_root_code", "event_base_code", "quad_class", "goldstein", "num_mentions", "avg_tone", "latitude", "longitude"]


@query("p1_p2_parse_events", with_sql(f"select {', '.join(PARSED)}, length(source_url) as url_length from parsed"))
def parse_events(spark, d):
    return clean.parse_events(raw_events(spark, d)).select(*PARSED, F.length("source_url").alias("url_length"))


@query("p2_parse_counts", with_sql("select count(*) filter (global_event_id >= 1 and event_date is not null) as n_parsed, count(*) filter (not coalesce(global_event_id >= 1 and event_date is not null, false)) as n_skipped from typed"))
def parse_counts(spark, d):
    return clean.parse_counts(raw_events(spark, d))


@query("p3_clamp_goldstein", with_sql("select goldstein, count(*) as n from parsed group by 1"))
def clamp_goldstein(spark, d):
    return clean.parse_events(raw_events(spark, d)).groupBy("goldstein").agg(F.count("*").alias("n"))


REJECTED = f"case when global_event_id is null or event_date is null then 'no_key' when event_date < date '{MIN_DATE}' then 'too_early' when coalesce(trim(action_geo_country), '') = '' then 'no_country' end"


@query("p4_rejection_counts", with_sql(f"select coalesce({REJECTED}, 'valid') as reason, count(*) as n from typed group by 1"))
def rejection_counts(spark, d):
    return clean.with_rejection(_typed(raw_events(spark, d)), MIN_DATE).groupBy(F.coalesce("rejected", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("p5_p6_normalised_events", with_sql(f"""select global_event_id, coalesce(n1.iso, upper(actor1_country)) as actor1_country, coalesce(n2.iso, upper(actor2_country)) as actor2_country,
  coalesce(n3.iso, upper(action_geo_country)) as action_geo_country, length(substring(source_url, 1, 2048)) as url_length, case when latitude between -90 and 90 then latitude end as latitude,
  case when longitude between -180 and 180 then longitude end as longitude from (select * from typed where {REJECTED} is null) t
  left join codes n1 on n1.code = upper(actor1_country) left join codes n2 on n2.code = upper(actor2_country) left join codes n3 on n3.code = upper(action_geo_country)""",
  "codes as (select n_name as code, 'N' || n_nationkey as iso from nation where n_nationkey % 3 = 0)"))
def normalised_events(spark, d):
    codes = table(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("code"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso"))
    e = clean.tidy_values(clean.normalise_countries(clean.valid_events(_typed(raw_events(spark, d)), MIN_DATE), codes))
    return e.select("global_event_id", "actor1_country", "actor2_country", "action_geo_country", F.length("source_url").alias("url_length"), "latitude", "longitude")


@query("p7_classified_events", with_sql("select category, quad_class, count(*) as n from classified group by 1, 2"))
def classified_events(spark, d):
    return clean.classified(facts(spark, d)).groupBy("category", "quad_class").agg(F.count("*").alias("n"))


@query("p8_risk_tiers", with_sql(f"select country, feature_date, risk_score, {TIER.format('risk_score')} as tier, case when risk_score is null or risk_score = 0 then 'UNKNOWN' else {TIER.format('risk_score')} end as heat_tier from risk"))
def risk_tiers(spark, d):
    return risk(spark, d).select("country", "feature_date", "risk_score", risk_tier(F.col("risk_score")).alias("tier"), risk_tier(F.col("risk_score"), True).alias("heat_tier"))


SHORT = "select *, left(action_geo_country, 1 + num_mentions % 3) as geo, left(actor1_country, 1 + num_mentions % 4) as act from facts"


def _short(spark, d):
    e = facts(spark, d)
    return e.withColumn("action_geo_country", F.expr("left(action_geo_country, 1 + num_mentions % 3)")).withColumn("actor1_country", F.expr("left(actor1_country, 1 + num_mentions % 4)"))


RESOLVED = f"resolved as (select *, case when length(geo) = 2 then geo else act end as country from ({SHORT}))"


@query("p9_resolved_country", with_sql("select country, count(*) as n from resolved where length(country) between 2 and 3 group by 1", RESOLVED))
def resolved_country(spark, d):
    return clean.resolved_country(_short(spark, d)).groupBy("country").agg(F.count("*").alias("n"))


@query("p10_p11_levels", with_sql("select country, feature_date, round(1 / (1 + exp(-(risk_score - 0.3) * 8)) + 1e-9, 6) as p, case when risk_score >= 0.75 then 3 when risk_score >= 0.5 then 2 when risk_score >= 0.25 then 1 else 0 end as level from risk"))
def levels(spark, d):
    return risk(spark, d).select("country", "feature_date", r6(sigmoid((F.col("risk_score") - 0.3) * 8)).alias("p"), level_bin(F.col("risk_score")).alias("level"))


@query("p12_cluster_browse", with_sql("select country, cluster_date, category, total_mentions from clusters where category in ('military', 'terrorism') and total_mentions >= 50"))
def cluster_browse(spark, d):
    return api.browse_clusters(features.event_clusters(facts(spark, d)), ["military", "terrorism"], 50).select("country", "cluster_date", "category", "total_mentions")


@query("p13_timeline", with_sql("select country, feature_date, risk_score from (select *, max(feature_date) over (partition by country) as newest from risk) where feature_date >= newest - 7"))
def timeline(spark, d):
    return clean.anchored_range(risk(spark, d).select("country", "feature_date", "risk_score"), "country", "feature_date", 7)


STATS = f"""count(*) as total_in, count(*) filter (ok and n > 1) as duplicates, count(*) filter (not ok) as invalid, count(*) filter (ok and n = 1) as total_out,
  round(count(*) filter (ok and n > 1) / greatest(count(*), 1) + 1e-9, 6) as dedup_rate
  from (select *, {REJECTED} is null as ok, row_number() over (partition by global_event_id order by arrival) as n from typed)"""


@query("d1_first_by_id", with_sql("select global_event_id, min(arrival) as arrival from parsed group by 1"))
def first_by_id(spark, d):
    e = _typed(raw_events(spark, d)).filter("global_event_id >= 1 and event_date is not null")
    return clean.first_by_id(e).select("global_event_id", "arrival")


@query("d1_unseen", with_sql("select global_event_id from facts where global_event_id not in (select global_event_id from facts where num_mentions < 50)"))
def unseen(spark, d):
    e = facts(spark, d)
    return clean.unseen(e, e.filter("num_mentions < 50")).select("global_event_id")


@query("d2_dedup_stats", with_sql(f"select {STATS}"))
def dedup_stats(spark, d):
    return clean.dedup_stats(_typed(raw_events(spark, d)), MIN_DATE)


F_COLS = "country, feature_date, total_events, conflict_events, cooperation_events, protest_score, violence_score, diplomatic_stress, economic_stress, terrorism_score, avg_sentiment, avg_goldstein"


@query("g1_daily_features", with_sql(f"select {F_COLS} from features"))
def daily_features(spark, d):
    return daily(spark, d)


@query("g2_rows_per_date", with_sql("select feature_date, count(*) as n from features where feature_date between date '2024-01-10' and date '2024-01-16' group by 1"))
def rows_per_date(spark, d):
    return features.rows_per_date(features.daily_features(facts(spark, d), "2024-01-10", "2024-01-16"))


KIND = "case event_root_code % 6 when 0 then 'PROTEST' when 1 then ' assault' when 2 then 'MOBILIZE' when 3 then 'RETREAT' when 4 then 'SANCTION' else 'CONSULT' end"
QUAD = "case quad_class when 1 then 'VERBAL COOPERATION' when 2 then 'MATERIAL COOPERATION' when 3 then 'VERBAL CONFLICT' when 4 then 'Material Conflict' end"


@query("g3_polecat_daily_features", with_sql("""select *, round(1.0::double - avg_goldstein + 1e-9, 6) as diplomatic_stress, round(cooperation_events / (conflict_events + cooperation_events) + 1e-9, 6) as avg_sentiment from (
  select country, event_date as feature_date, count(*) as total_events, count(*) filter (cf) as conflict_events, count(*) filter (not cf) as cooperation_events,
  round(count(*) filter (kind = 'PROTEST') / count(*) + 1e-9, 6) as protest_score, round(count(*) filter (kind in ('ASSAULT', 'MOBILIZE', 'RETREAT')) / count(*) + 1e-9, 6) as violence_score,
  round(count(*) filter (kind = 'ASSAULT' and contains(quad, 'MATERIAL CONFLICT')) / count(*) + 1e-9, 6) as terrorism_score, round(count(*) filter (kind = 'SANCTION') / count(*) + 1e-9, 6) as economic_stress,
  round((coalesce(avg(goldstein), 0) + 10) / 20 + 1e-9, 6) as avg_goldstein from pc group by 1, 2)""",
  f"pc as (select action_geo_country as country, event_date, upper(trim({KIND})) as kind, upper(trim({QUAD})) as quad, coalesce(contains(upper({QUAD}), 'CONFLICT'), false) as cf, goldstein from facts)"))
def polecat_daily_features(spark, d):
    e = facts(spark, d).select(F.col("action_geo_country").alias("country"), "event_date", F.expr(KIND).alias("event_type"), F.expr(QUAD).alias("quad_code"), F.col("goldstein").alias("event_intensity"))
    return features.polecat_daily_features(e)


WEIGHTED = """weighted as (select country, event_date, count(*) as n_events, round(sum(case when quad_class in (3, 4) then w else 0 end) / sum(w) + 1e-9, 6) as protest,
  round(sum(case when quad_class = 4 then w else 0 end) / sum(w) + 1e-9, 6) as violence, round(greatest(-sum(coalesce(goldstein, 0) * w) / sum(w), 0) / 10 + 1e-9, 6) as diplo,
  round(sum(case when left(event_root_code::varchar, 2) in ('16', '17') then w else 0 end) / sum(w) + 1e-9, 6) as econ,
  round(sum(case when event_base_code::varchar like '18%' then w else 0 end) / sum(w) + 1e-9, 6) as terror,
  round(least(greatest(-sum(coalesce(avg_tone, 0) * w) / sum(w), 0) / 30, 1) + 1e-9, 6) as tone_neg, round((sum(coalesce(goldstein, 0) * w) / sum(w) + 10) / 20 + 1e-9, 6) as goldstein_norm
  from (select *, action_geo_country as country, greatest(coalesce(num_mentions, 1), 1)::double as w from facts) group by 1, 2 having count(*) >= 5)"""


def _weighted(spark, d):
    return features.weighted_daily_features(facts(spark, d).withColumn("country", F.col("action_geo_country")))


@query("g4_weighted_daily_features", with_sql("select * from weighted", WEIGHTED))
def weighted_daily_features(spark, d):
    return _weighted(spark, d)


RANKED = ", ".join(f"case when n < 5 then {c} else round(row_number() over (partition by event_date order by {c}{' desc' if c == 'goldstein_norm' else ''}, country) / n + 1e-9, 6) end as {c}" for c in features.WEIGHTED)


@query("w8_percentile_rank_day", with_sql(f"select country, event_date, {RANKED} from (select *, count(*) over (partition by event_date) as n from weighted)", WEIGHTED))
def percentile_rank_day(spark, d):
    return features.percentile_rank_day(_weighted(spark, d))


@query("g5_event_clusters", with_sql("select * from clusters"))
def event_clusters(spark, d):
    return features.event_clusters(facts(spark, d))


PAIRS = """pairs as (select * from (select *, row_number() over (partition by country, cluster_date, category order by n desc, actor1, actor2) as rank from (
  select action_geo_country as country, event_date as cluster_date, category, left(coalesce(nullif(actor1_name, ''), actor1_country), 40) as actor1, left(coalesce(nullif(actor2_name, ''), actor2_country), 40) as actor2, count(*) as n
  from classified group by 1, 2, 3, 4, 5) where coalesce(actor1, '') <> '' and coalesce(actor2, '') <> '') where rank <= 5)"""


@query("g6_top_actor_pairs", with_sql("select country, cluster_date, category, actor1, actor2, n, rank from pairs", PAIRS))
def top_actor_pairs(spark, d):
    return features.top_actor_pairs(facts(spark, d)).select("country", "cluster_date", "category", F.explode("pairs").alias("p")).select("country", "cluster_date", "category", "p.actor1", "p.actor2", "p.n", "p.rank")


@query("g39_merged_actor_pairs", with_sql("select actor1, actor2, sum(n)::bigint as n from pairs group by 1, 2 order by n desc, actor1, actor2 limit 10", PAIRS))
def merged_actor_pairs(spark, d):
    return features.merged_actor_pairs(features.pairs_json(features.top_actor_pairs(facts(spark, d))))


LSTAT = """lstat as (select action_geo_country as country, event_date as label_date, count(*) as n,
  sum(case when quad_class = 4 then 1.0::double when quad_class = 3 then 0.5 when event_root_code = 14 then 0.3 else 0 end * (1 + ln(1 + m) / 10)) as conflict,
  1.5::double * count(*) filter (event_root_code in (19, 20)) + 2 * count(*) filter (event_root_code = 20) + 0.5 * count(*) filter (event_root_code between 15 and 20) + 0.3 * count(*) filter (coalesce(actor1_country, '') <> '' and coalesce(actor2_country, '') <> '' and actor1_country <> actor2_country) as war,
  count(*) filter (event_root_code in (19, 20)) as fights, coalesce(sum(m) filter (event_root_code in (19, 20)), 0) as fight_mentions,
  coalesce(sum(case when event_base_code in (183, 185) then 2 else 1 end * (1 + ln(1 + m) / 8)) filter (event_base_code between 180 and 186 or (event_root_code in (18, 19, 20) and quad_class = 4)), 0) as terror,
  1.5::double * count(*) filter (event_base_code in (163, 168)) + 0.8 * count(*) filter (event_root_code in (15, 16) and quad_class in (3, 4)) + 0.2 * count(*) filter (avg_tone < -10) as money
  from (select *, coalesce(nullif(num_mentions, 0), 1)::double as m from facts) group by 1, 2)"""
SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
WAR = lambda w, n, f, m, cf, cn: SIG(f"(({w} / {n} * (1 + 0.5 * coalesce({cf} / greatest({cn}, 1), 0))) * (case when {m} > 0 then 1 + ln(1 + {m} / greatest({f}, 1)) / 10 else 1 end) - 0.4) * 6")
LABELS = f"""ctx as (select *, {', '.join(f'coalesce(sum({c}) over w, 0) as c_{c}' for c in ('n', 'conflict', 'war', 'fights', 'fight_mentions'))} from lstat
  window w as (partition by country order by label_date range between interval 7 days preceding and interval 1 day preceding)),
labels_ as (select country, label_date, n as event_count,
  round(least(0.7 * {SIG('(conflict / n - 0.3) * 8')} + 0.3 * case when c_n > 0 then {SIG('(c_conflict / c_n - 0.3) * 8')} else 0 end, 1) + 1e-9, 6) as instability_label,
  round(least(0.7 * {WAR('war', 'n', 'fights', 'fight_mentions', 'c_fights', 'c_n')} + 0.3 * case when c_n > 0 then {WAR('c_war', 'c_n', 'c_fights', 'c_fight_mentions', '0', '1')} else 0 end, 1) + 1e-9, 6) as war_label,
  round({SIG('(terror / n - 0.3) * 7')} + 1e-9, 6) as terrorism_label, round({SIG('(money / n - 0.2) * 8')} + 1e-9, 6) as financial_label from ctx)"""


@query("g7_g10_daily_signals", with_sql(f"select country, label_date, round({SIG('(conflict / n - 0.3) * 8')} + 1e-9, 6) as instability, round({WAR('war', 'n', 'fights', 'fight_mentions', '0', '1')} + 1e-9, 6) as war, round({SIG('(terror / n - 0.3) * 7')} + 1e-9, 6) as terrorism, round({SIG('(money / n - 0.2) * 8')} + 1e-9, 6) as financial from lstat", LSTAT))
def daily_signals(spark, d):
    return labels.daily_signals(facts(spark, d))


@query("g11_multitask_labels", with_sql("select * from labels_", LSTAT, LABELS))
def multitask_labels(spark, d):
    return labels.multitask_labels(facts(spark, d))


AVG = lambda cols, r=6: ", ".join(f"round(avg({c}) + 1e-9, {r}) as {c}" for c in cols)


@query("g12_weekly_features", with_sql(f"select country, date_trunc('week', feature_date)::date as week, sum(total_events)::bigint as total_events, {AVG(features.SCORES)} from features group by 1, 2"))
def weekly_features(spark, d):
    return features.weekly_features(daily(spark, d))


@query("g13_global_risk_summary", with_sql("select feature_date, count(*) as countries, round(avg(risk_score) + 1e-9, 6) as avg_risk, max(risk_score) as max_risk, round(quantile_cont(risk_score, 0.9) + 1e-9, 6) as p90_risk from risk group by 1"))
def global_risk_summary(spark, d):
    return features.global_risk_summary(risk(spark, d))


@query("g14_labeled_countries", with_sql(f"select country, min(label_date) as first_date, max(label_date) as last_date, count(*) as days, {', '.join(f'round(avg({t}_label) + 1e-9, 6) as avg_{t}' for t in labels.TASKS)} from labels_ group by 1 having count(*) >= 10", LSTAT, LABELS))
def labeled_countries(spark, d):
    return features.labeled_countries(labels.multitask_labels(facts(spark, d)), 10)


@query("g15_list_countries", with_sql("select country, max(feature_date) as last_date, count(*) as days from features group by 1"))
def list_countries(spark, d):
    return features.list_countries(daily(spark, d))


COOC = """directed as (select actor1_country a, actor2_country b, count(*) n from facts where quad_class in (3, 4) and actor2_country is not null and actor1_country <> actor2_country group by 1, 2 having count(*) >= 2),
cooc as (select least(a, b) as country_a, greatest(a, b) as country_b, sum(n)::bigint as events from directed group by 1, 2)"""


@query("g18_cooccurrence", with_sql("select * from cooc", COOC))
def cooccurrence(spark, d):
    return network.cooccurrence(facts(spark, d), min_events=2)


LONG = "long_ as (" + " union all ".join(f"select country, feature_date, '{c}' as feature, {c} as value from features" for c in features.SCORES) + ")"
NORM = f"norm as (select country, feature, count(value) as n, round(avg(value) + 1e-9, 6) as mean, round(case when stddev_pop(value) <= 1e-9 then 1 else stddev_pop(value) end + 1e-9, 6) as std, date '{AS_OF}' as computed_date from long_ where feature_date <= date '{AS_OF}' and feature_date > date '{AS_OF}' - 14 group by 1, 2 having count(value) >= 3)"


@query("g19_rolling_norm_stats", with_sql("select * from norm", LONG, NORM))
def rolling_norm_stats(spark, d):
    return features.rolling_norm_stats(daily(spark, d), AS_OF, 14)


@query("g20_zscores", with_sql("select country, feature_date, feature, round(z + 1e-9, 4) as z, round(least(greatest(z, -3), 3) + 1e-9, 4) as z_clipped from (select country, feature_date, feature, case when std < 1e-9 then 0 else (value - mean) / std end as z from long_ join norm using (country, feature))", LONG, NORM))
def zscores(spark, d):
    f = daily(spark, d)
    return features.zscores(f, features.rolling_norm_stats(f, AS_OF, 14))


@query("g21_resample_biweekly", with_sql(f"select country, (date_diff('day', first, feature_date) // 14)::int as bin, count(*) as n, {AVG(features.SCORES)} from (select *, min(feature_date) over (partition by country) as first from features) group by 1, 2"))
def resample_biweekly(spark, d):
    return features.resample_biweekly(daily(spark, d))


@query("g38_category_summary", with_sql("select country, category, sum(event_count)::bigint as events, sum(total_mentions)::bigint as mentions, round(avg(avg_goldstein) + 1e-9, 4) as avg_goldstein from clusters group by 1, 2"))
def category_summary(spark, d):
    return features.category_summary(features.event_clusters(facts(spark, d)))


@query("g38_explorer_kpis", with_sql("select sum(event_count)::bigint as events, sum(total_mentions)::bigint as mentions, count(distinct cluster_date) as days, count(distinct category) as categories, count(distinct country) as countries from clusters"))
def explorer_kpis(spark, d):
    return features.explorer_kpis(features.event_clusters(facts(spark, d)))


@query("g38_mentions_over_time", with_sql("select cluster_date, category, sum(total_mentions)::bigint as mentions from clusters group by 1, 2"))
def mentions_over_time(spark, d):
    return features.mentions_over_time(features.event_clusters(facts(spark, d)))


@query("g40_actor_registry", with_sql("""select actor_code, first(name order by event_date desc, global_event_id desc) filter (true) as name, first(country order by event_date desc, global_event_id desc) as country,
  first(type order by event_date desc, global_event_id desc) as type, sum(num_mentions)::bigint as mentions, max(event_date) as last_seen from (
  select actor1_code as actor_code, actor1_name as name, actor1_country as country, actor1_type1 as type, num_mentions, event_date, global_event_id from facts where actor1_name is not null union all
  select actor2_code, actor2_name, actor2_country, actor2_type1, num_mentions, event_date, global_event_id from facts where actor2_code is not null and actor1_code <> actor2_code) group by 1"""))
def actor_registry(spark, d):
    # an event with one code on both sides would tie with itself for the newest name
    e = facts(spark, d)
    same = F.col("actor1_code") == F.coalesce("actor2_code", F.lit(""))
    e = e.withColumn("actor2_code", F.when(~same, F.col("actor2_code"))).withColumn("actor1_code", F.when(F.col("actor1_name").isNotNull(), F.col("actor1_code")))
    return features.actor_registry(e)


@query("g41_country_coverage", with_sql("select country, count(*) as days from features where total_events > 0 group by 1 order by days desc, country limit 10"))
def country_coverage(spark, d):
    return features.country_coverage(daily(spark, d))
