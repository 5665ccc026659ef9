"""Scans of landed files: event lines of both versions, typed event files, archives, snapshots, manifests, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.manifest import ManifestFiles

# The positional columns of raw event lines.
_ACTOR = ("code", "name", "country_code", "known_group_code", "ethnic_code", "religion1_code", "religion2_code", "type1_code", "type2_code", "type3_code")
_EVENT = ("is_root_event", "event_code", "event_base_code", "event_root_code", "quad_class", "goldstein_scale", "num_mentions", "num_sources", "num_articles", "avg_tone")
_GEO_V1 = ("type", "fullname", "country_code", "adm1_code", "lat", "long", "feature_id")
_GEO_V2 = ("type", "fullname", "country_code", "adm1_code", "adm2_code", "lat", "long", "feature_id")


def _columns(geo: tuple[str, ...]) -> list[str]:
    return [
        "global_event_id", "sqldate", "month_year", "year", "fraction_date",
        *[f"actor1_{c}" for c in _ACTOR], *[f"actor2_{c}" for c in _ACTOR], *_EVENT,
        *[f"{place}_geo_{c}" for place in ("actor1", "actor2", "action") for c in geo], "date_added", "source_url",
    ]


V1_COLUMNS, V2_COLUMNS = _columns(_GEO_V1), _columns(_GEO_V2)


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_events_v1(spark: SparkSession, path: str) -> DataFrame:
    """58 text columns, tab-separated, no header, Latin-1; lines with fewer fields are dropped, extra fields ignored."""
    return _events(spark, path, V1_COLUMNS, len(V1_COLUMNS))


def read_events_v2(spark: SparkSession, path: str) -> DataFrame:
    """61 text columns; lines with at least 58 fields are taken, absent ones are null."""
    return _events(spark, path, V2_COLUMNS, len(V1_COLUMNS))


def _events(spark: SparkSession, path: str, columns: list[str], least: int) -> DataFrame:
    schema = _schema([*columns, "__bad"])
    rows = spark.read.csv(path, sep="\t", encoding="ISO-8859-1", schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", quote='"')
    fields = F.when(F.col("__bad").isNull(), F.lit(len(columns))).otherwise(F.size(F.split("__bad", "\t")))
    return rows.filter(fields >= least).drop("__bad")


POLECAT_COLUMNS = {"Event Date": "event_date", "Country": "iso3", "Event Type": "event_type", "Quad Code": "quad_code", "Event Intensity": "event_intensity"}


def read_polecat(spark: SparkSession, path: str, years: list[int] | None = None, target_date: str | None = None) -> DataFrame:
    """Headered TSV; of files whose name has a wanted year; typed, optionally of one date."""
    rows = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8").withColumn("__file", F.col("_metadata.file_name"))
    if years:
        rows = rows.filter(F.col("__file").rlike("|".join(map(str, years))))
    out = rows.select(
        F.try_to_date(F.trim("`Event Date`"), "yyyy-MM-dd").alias("event_date"), F.trim("`Country`").alias("iso3"), F.col("`Event Type`").alias("event_type"),
        F.col("`Quad Code`").alias("quad_code"), F.nullif(F.trim("`Event Intensity`"), F.lit("")).try_cast("double").alias("event_intensity")).filter("event_date is not null")
    return out.filter(F.col("event_date") == F.lit(target_date).cast("date")) if target_date else out


def expand_zip_archives(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".txt")) -> DataFrame:
    """file and line of every text member of the zip archives in the folder ``path``. A task streams members by range reads,
    one of a large archive or those of many small ones; suffixes are matched without regard to case, and what can't be read raises."""
    spark.dataSource.register(ManifestFiles)
    rows = spark.read.format("manifest_files").option("path", path).option("names", "*.zip").option("suffixes", ",".join(suffixes)).load()
    return rows.select(F.element_at(F.split("file_url", "/"), -1).alias("file"), "line")


def events_of_lines(lines: DataFrame, columns: list[str] = V2_COLUMNS, least: int = 58, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw text columns of expanded archive lines, and the columns ``keep`` as they are."""
    parts = F.split("line", "\t", -1)
    return lines.filter(F.size(parts) >= least).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)], *keep)


SNAPSHOT_NAMES = ("protest", "violence", "diplo", "econ", "terror", "tone_neg", "goldstein_norm")


def read_feature_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """country, snapshot_date and seven features of ``YYYYMMDD_features.parquet`` files or folders; f0..f6 or named columns.

    Unreadable files are skipped. A folder's name may have a prefix, as ``day=`` of a partitioned write.
    """
    rows = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(f"{path.rstrip('/')}/*_features.parquet")
    date = F.try_to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{8})_features\.parquet", 1), "yyyyMMdd")
    pick = lambda i, n: F.coalesce(*[F.col(c) for c in (n, f"f{i}") if c in rows.columns], F.lit(None)).cast("double").alias(n)
    return rows.select("country", date.alias("snapshot_date"), *[pick(i, n) for i, n in enumerate(SNAPSHOT_NAMES)])


def read_file_manifest(spark: SparkSession, path: str, suffix: str = ".export.CSV.zip") -> DataFrame:
    """file_url and file_ts of listing lines ``size hash url``; a name without 14 leading digits has the current time."""
    url = F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    lines = spark.read.text(path).select(url.alias("file_url")).filter(F.endswith("file_url", F.lit(suffix)))
    stamp = F.regexp_extract(F.element_at(F.split("file_url", "/"), -1), r"^(\d{14})", 1)
    return lines.withColumn("file_ts", F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMddHHmmss")), F.current_timestamp()))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Calibration quantiles or fold logs written as JSON."""
    return spark.read.schema(schema).json(path)


def country_names(codes: DataFrame, names: DataFrame) -> DataFrame:
    """``codes`` (code) with name from ``names`` (code, name), upper-cased; the code itself where there is none."""
    n = names.select(F.upper("code").alias("__c"), F.upper("name").alias("__n"))
    return codes.join(n, F.upper("code") == F.col("__c"), "left").withColumn("name", F.coalesce("__n", F.upper("code"))).drop("__c", "__n")


def translated(rows: DataFrame, mapping: DataFrame, source: str = "iso3", target: str = "country") -> DataFrame:
    """``rows`` with ``source`` translated by ``mapping`` (iso3, fips); rows without a translation go."""
    m = mapping.filter("fips is not null").select(F.col("iso3").alias("__k"), F.col("fips").alias(target))
    return rows.join(m, F.col(source) == F.col("__k")).drop("__k", source)
