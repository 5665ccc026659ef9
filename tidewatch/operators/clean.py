"""Parsing, validation and deduplication of event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import category, clamp, clean_date, clean_double, clean_int, clean_long, clean_text, n_if

TEXTS = ("actor1_code", "actor1_name", "actor1_country_code", "actor1_type1_code", "actor2_code", "actor2_name", "actor2_country_code", "actor2_type1_code", "action_geo_country_code", "source_url")
RENAMED = {"actor1_country_code": "actor1_country", "actor2_country_code": "actor2_country", "actor1_type1_code": "actor1_type1", "actor2_type1_code": "actor2_type1", "action_geo_country_code": "action_geo_country"}


def typed_events(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 23 typed columns of raw all-text rows, and the columns ``keep`` as they are; columns that ``raw`` lacks are null."""
    c = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
    counts = {n: F.coalesce(clean_int(c(n)), F.lit(0)) for n in ("num_mentions", "num_sources", "num_articles")}
    return raw.select(
        clean_long(c("global_event_id")).alias("global_event_id"),
        clean_date(c("sqldate")).alias("event_date"),
        *[clean_text(c(n)).alias(RENAMED.get(n, n)) for n in TEXTS],
        *[clean_int(c(n)).alias(n) for n in ("event_code", "event_base_code", "event_root_code", "quad_class")],
        clamp(clean_double(c("goldstein_scale")), -10, 10).alias("goldstein"),
        *[v.alias(k) for k, v in counts.items()],
        clean_double(c("avg_tone")).alias("avg_tone"),
        clean_double(c("action_geo_lat")).alias("latitude"),
        clean_double(c("action_geo_long")).alias("longitude"), *keep,
    )


def _valid(t: DataFrame):
    return (F.coalesce(F.col("global_event_id"), F.lit(0)) >= 1) & F.col("event_date").isNotNull()


def parse_events(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    t = typed_events(raw, keep)
    return t.filter(_valid(t))


def parse_counts(raw: DataFrame) -> DataFrame:
    """n_parsed and n_skipped."""
    t = typed_events(raw)
    return t.agg(n_if(_valid(t)).alias("n_parsed"), n_if(~_valid(t)).alias("n_skipped"))


def with_rejection(events: DataFrame, min_date: str) -> DataFrame:
    """``events`` with why a row is invalid, or null."""
    return events.withColumn(
        "rejected",
        F.when(F.col("global_event_id").isNull() | F.col("event_date").isNull(), "no_key")
        .when(F.col("event_date") < F.lit(min_date).cast("date"), "too_early")
        .when(F.coalesce(F.trim("action_geo_country"), F.lit("")) == "", "no_country"),
    )


def valid_events(events: DataFrame, min_date: str) -> DataFrame:
    return with_rejection(events, min_date).filter("rejected is null").drop("rejected")


def normalise_countries(events: DataFrame, codes: DataFrame, columns=("actor1_country", "actor2_country", "action_geo_country")) -> DataFrame:
    """Upper-cased codes; those in ``codes`` (code, iso) are translated. One equi-join per column, sized by Catalyst."""
    out = events
    for c in columns:
        side = codes.select(F.col("code").alias("__code"), F.col("iso").alias("__iso"))
        out = out.withColumn(c, F.upper(c)).join(side, F.col(c) == F.col("__code"), "left").withColumn(c, F.coalesce("__iso", c)).drop("__code", "__iso")
    return out


def tidy_values(events: DataFrame, url_length: int = 2048) -> DataFrame:
    """URLs cut; coordinates out of range become null."""
    return events.withColumns({
        "source_url": F.substring("source_url", 1, url_length),
        "latitude": F.when(F.col("latitude").between(-90, 90), F.col("latitude")),
        "longitude": F.when(F.col("longitude").between(-180, 180), F.col("longitude")),
    })


def first_by_id(events: DataFrame, key: str = "global_event_id", arrival: str = "arrival") -> DataFrame:
    """The first row of each id by arrival, exactly."""
    w = Window.partitionBy(key).orderBy(arrival)
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unseen(events: DataFrame, history: DataFrame, keys=("global_event_id",)) -> DataFrame:
    return events.join(history.select(*keys), list(keys), "left_anti")


def dedup_stats(events: DataFrame, min_date: str, by: list[str] | None = None) -> DataFrame:
    """total_in, duplicates, invalid, total_out and dedup_rate, in one pass over rows numbered within their id."""
    w = Window.partitionBy("global_event_id").orderBy("arrival")
    v = with_rejection(events, min_date).withColumn("n", F.row_number().over(w))
    ok = F.col("rejected").isNull()
    return v.groupBy(*(by or [])).agg(
        F.count("*").alias("total_in"),
        n_if(ok & (F.col("n") > 1)).alias("duplicates"),
        n_if(~ok).alias("invalid"),
        n_if(ok & (F.col("n") == 1)).alias("total_out"),
    ).withColumn("dedup_rate", F.round(F.col("duplicates") / F.greatest("total_in", F.lit(1)) + 1e-9, 6))


def classified(events: DataFrame) -> DataFrame:
    return events.withColumn("category", category(F.col("event_root_code"), F.col("event_base_code"), F.col("quad_class")))


def resolved_country(events: DataFrame) -> DataFrame:
    """country: the action code if it has two characters, else the first actor's; two or three characters long."""
    c = F.when(F.length("action_geo_country") == 2, F.col("action_geo_country")).otherwise(F.col("actor1_country"))
    return events.withColumn("country", c).filter(F.length("country").between(2, 3))


def anchored_range(df: DataFrame, key: str, date: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before each key's own newest row."""
    newest = df.groupBy(key).agg(F.max(date).alias("__newest"))
    return df.join(newest, key).filter(F.col(date) >= F.date_sub("__newest", days)).drop("__newest")
