"""The test tables seen as event records, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = e.select("event_id", "ts", F.to_date("ts").alias("event_date"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    a = n.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("name1"))
    b = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name2"))
    return k.join(a, F.col("user_id") % 25 == F.col("k1")).join(b, F.col("k") % 25 == F.col("k2"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean event records: one row per event."""
    k = F.col("k")
    quad = F.expr("case event_type when 'view' then 1 when 'purchase' then 2 when 'click' then 3 when 'error' then 4 end")
    return _base(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("global_event_id"), "event_date", F.col("name1").alias("actor1_country"),
        F.when(k % 7 == 0, None).otherwise(F.col("name2")).alias("actor2_country"), F.col("name1").alias("action_geo_country"),
        F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("A"), F.col("name1"))).alias("actor1_name"),
        F.when(k % 7 == 0, None).otherwise(F.concat(F.lit("B"), F.col("name2"))).alias("actor2_name"),
        F.concat(F.lit("C"), (F.col("user_id") % 40).cast("string")).alias("actor1_code"),
        F.when(k % 7 == 0, None).otherwise(F.concat(F.lit("C"), (k % 40).cast("string"))).alias("actor2_code"),
        F.lit("GOV").alias("actor1_type1"), F.lit("CIV").alias("actor2_type1"),
        (1 + k % 20).alias("event_root_code"), ((1 + k % 20) * 10 + F.col("event_id") % 10).cast("int").alias("event_base_code"), quad.cast("int").alias("quad_class"),
        F.when(k % 10 == 0, None).otherwise(F.round(F.col("value") % 20 - 10, 2)).alias("goldstein"),
        F.greatest(F.lit(-100.0), F.round(50 - F.col("value"), 2)).alias("avg_tone"), k.alias("num_mentions"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as landed text, with bad ids and dates, blanks, values out of range and repeated rows."""
    k, t = F.col("k"), lambda c: c.cast("string")
    r = _base(spark, sf_dir).select(
        F.when(k % 61 == 0, "bad").otherwise(t(F.col("event_id") + 1)).alias("global_event_id"),
        F.when(k % 53 == 0, "").when(k % 59 == 0, "20241399").otherwise(F.date_format("event_date", "yyyyMMdd")).alias("sqldate"),
        F.concat(F.lit(" "), "name1", F.lit(" ")).alias("actor1_country_code"), F.when(k % 7 == 0, "").otherwise(F.col("name2")).alias("actor2_country_code"),
        F.when(k % 11 == 0, "").otherwise(F.lower("name1")).alias("action_geo_country_code"),
        F.concat(t(1 + k % 20), F.lit(".0")).alias("event_root_code"), F.when(k % 13 == 0, "x").otherwise(t((1 + k % 20) * 10)).alias("event_base_code"),
        F.expr("case event_type when 'view' then '1' when 'purchase' then ' 2' when 'click' then '3' when 'error' then '4.0' else '' end").alias("quad_class"),
        F.when(k % 10 == 0, "").otherwise(F.concat(t(k % 40 - 20), F.lit(".5"))).alias("goldstein_scale"),
        F.when(k % 17 == 0, "").otherwise(F.concat(t(k), F.lit(".0"))).alias("num_mentions"), F.when(k % 9 == 0, "n/a").otherwise(t(50 - k)).alias("avg_tone"),
        t(k * 2 - 95).alias("action_geo_lat"), t(k * 4 - 200).alias("action_geo_long"), F.repeat(F.lit("u"), k * 30).alias("source_url"), F.col("event_id").alias("arrival"), "k")
    again = r.filter("k % 8 = 3").withColumn("arrival", F.col("arrival") + 10_000_000)
    return r.unionByName(again)


#: DuckDB CTEs of the same frames: k_, facts, raw and, from them, features and risk.
SQL = """
k_ as (select e.event_id, cast(e.ts as date) as event_date, e.user_id, e.event_type, e.value, cast(json_extract_string(e.props, '$.k') as int) as k,
  a.n_name as name1, b.n_name as name2 from events e join nation a on a.n_nationkey = e.user_id % 25
  join nation b on b.n_nationkey = cast(json_extract_string(e.props, '$.k') as int) % 25),
facts as (select event_id + 1 as global_event_id, event_date, name1 as actor1_country, case when k % 7 = 0 then null else name2 end as actor2_country,
  name1 as action_geo_country, case when k % 5 = 0 then null else 'A' || name1 end as actor1_name, case when k % 7 = 0 then null else 'B' || name2 end as actor2_name,
  'C' || (user_id % 40) as actor1_code, case when k % 7 = 0 then null else 'C' || (k % 40) end as actor2_code, 'GOV' as actor1_type1, 'CIV' as actor2_type1,
  1 + k % 20 as event_root_code, ((1 + k % 20) * 10 + event_id % 10)::int as event_base_code,
  case event_type when 'view' then 1 when 'purchase' then 2 when 'click' then 3 when 'error' then 4 end as quad_class,
  case when k % 10 = 0 then null else round(value % 20 - 10, 2) end as goldstein, greatest(-100.0::double, round(50 - value, 2)) as avg_tone, k as num_mentions from k_),
raw_ as (select case when k % 61 = 0 then 'bad' else (event_id + 1)::varchar end as global_event_id,
  case when k % 53 = 0 then '' when k % 59 = 0 then '20241399' else strftime(event_date, '%Y%m%d') end as sqldate,
  ' ' || name1 || ' ' as actor1_country_code, case when k % 7 = 0 then '' else name2 end as actor2_country_code,
  case when k % 11 = 0 then '' else lower(name1) end as action_geo_country_code, (1 + k % 20) || '.0' as event_root_code,
  case when k % 13 = 0 then 'x' else ((1 + k % 20) * 10)::varchar end as event_base_code,
  case event_type when 'view' then '1' when 'purchase' then ' 2' when 'click' then '3' when 'error' then '4.0' else '' end as quad_class,
  case when k % 10 = 0 then '' else (k % 40 - 20) || '.5' end as goldstein_scale, case when k % 17 = 0 then '' else k || '.0' end as num_mentions,
  case when k % 9 = 0 then 'n/a' else (50 - k)::varchar end as avg_tone, (k * 2 - 95)::varchar as action_geo_lat, (k * 4 - 200)::varchar as action_geo_long,
  repeat('u', k * 30) as source_url, event_id as arrival, k from k_),
raw as (select * from raw_ union all select * replace (arrival + 10000000 as arrival) from raw_ where k % 8 = 3),
typed as (select try_cast(try_cast(nullif(trim(global_event_id), '') as double) as bigint) as global_event_id,
  case when length(trim(sqldate)) = 8 then try_cast(try_strptime(trim(sqldate), '%Y%m%d') as date) end as event_date,
  nullif(trim(actor1_country_code), '') as actor1_country, nullif(trim(actor2_country_code), '') as actor2_country, nullif(trim(action_geo_country_code), '') as action_geo_country,
  nullif(trim(source_url), '') as source_url, trunc(try_cast(nullif(trim(event_root_code), '') as double))::int as event_root_code,
  trunc(try_cast(nullif(trim(event_base_code), '') as double))::int as event_base_code, trunc(try_cast(nullif(trim(quad_class), '') as double))::int as quad_class,
  case when try_cast(nullif(trim(goldstein_scale), '') as double) is not null then least(greatest(try_cast(nullif(trim(goldstein_scale), '') as double), -10), 10) end as goldstein,
  coalesce(trunc(try_cast(nullif(trim(num_mentions), '') as double))::int, 0) as num_mentions, try_cast(nullif(trim(avg_tone), '') as double) as avg_tone,
  try_cast(nullif(trim(action_geo_lat), '') as double) as latitude, try_cast(nullif(trim(action_geo_long), '') as double) as longitude, arrival from raw),
parsed as (select * from typed where global_event_id >= 1 and event_date is not null),
features as (select action_geo_country as country, event_date as feature_date, count(*) as total_events,
  count(*) filter (quad_class in (3, 4)) as conflict_events, count(*) filter (quad_class in (1, 2)) as cooperation_events,
  round(count(*) filter (event_root_code = 14) / count(*) + 1e-9, 6) as protest_score,
  round(count(*) filter (coalesce(quad_class, 0) = 4 or event_root_code in (18, 19, 20)) / count(*) + 1e-9, 6) as violence_score,
  round(1.0::double - (coalesce(avg(goldstein), 0) + 10) / 20 + 1e-9, 6) as diplomatic_stress,
  round(count(*) filter (event_root_code in (15, 16, 163)) / count(*) + 1e-9, 6) as economic_stress,
  round(count(*) filter (event_root_code in (18, 19, 20) and quad_class = 4) / count(*) + 1e-9, 6) as terrorism_score,
  round(least(greatest((coalesce(avg(avg_tone), 0) + 100) / 200, 0), 1) + 1e-9, 6) as avg_sentiment,
  round((coalesce(avg(goldstein), 0) + 10) / 20 + 1e-9, 6) as avg_goldstein from facts group by 1, 2),
heads as (select *, round(least(0.5 * violence_score + 0.5 * protest_score, 1) + 1e-9, 6) as instability,
  round(least(0.4 * violence_score + 0.4 * diplomatic_stress + 0.2 * avg_goldstein, 1) + 1e-9, 6) as war,
  round(least(1.2 * terrorism_score, 1) + 1e-9, 6) as terrorism, round(least(0.7 * economic_stress + 0.3 * avg_sentiment, 1) + 1e-9, 6) as financial from features),
risk as (select *, round(least(greatest(0.4 * instability + 0.3 * war + 0.2 * terrorism + 0.1 * financial, 0), 1) + 1e-9, 6) as risk_score from heads),
classified as (select *, case when event_root_code is null then 'diplomatic'
  when quad_class = 4 and (event_base_code between 180 and 186 or event_root_code in (18, 20)) then 'terrorism'
  when event_base_code in (163, 168, 172, 173) then 'sanctions'
  when event_root_code in (15, 16, 17, 19, 20) and quad_class in (3, 4) then 'military' when event_root_code = 14 then 'protest' else 'diplomatic' end as category from facts),
clusters as (select action_geo_country as country, event_date as cluster_date, category, count(*) as event_count, sum(coalesce(num_mentions, 0))::bigint as total_mentions,
  round(avg(goldstein) + 1e-9, 4) as avg_goldstein, round(avg(avg_tone) + 1e-9, 4) as avg_tone, round(max(abs(goldstein)) + 1e-9, 4) as max_intensity from classified group by 1, 2, 3)"""


def with_sql(select: str, *ctes: str) -> str:
    return "with " + ",\n".join([SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + select


AS_OF = "2024-01-30"
