import uuid
import zipfile
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewatch.operators import labels, scoring
from tidewatch.plans import catalog_models
from tidewatch.sources import readers, sinks
from tidewatch.sources.history import History
from tidewatch.sources.versioned import VersionedTable
from tidewatch.streaming import jobs

SF = "/root/testdata/sf0.001"


def line(n, columns, **values):
    return "\t".join((values | {"global_event_id": str(n)}).get(c, "") for c in columns)


def test_event_lines(spark, tmp_path):
    v1, v2 = readers.V1_COLUMNS, readers.V2_COLUMNS
    assert (len(v1), len(v2)) == (58, 61)
    (tmp_path / "a.csv").write_bytes("\n".join([line(1, v1, source_url="http://é"), "\t".join(["x"] * 20), line(2, v1) + "\textra"]).encode("latin-1"))
    assert [(r.global_event_id, r.source_url) for r in readers.read_events_v1(spark, str(tmp_path / "a.csv")).collect()] == [("1", "http://é"), ("2", None)]
    (tmp_path / "b.csv").write_text("\n".join([line(3, v2, action_geo_lat="1.5"), "\t".join(["4"] * 58), "\t".join(["5"] * 57)]))
    rows = readers.read_events_v2(spark, str(tmp_path / "b.csv")).collect()
    assert [r.global_event_id for r in rows] == ["3", "4"] and rows[0].action_geo_lat == "1.5" and rows[1].source_url is None


def test_zip_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "20240101.export.CSV.zip", "w") as z:
        z.writestr("20240101.export.CSV", "\n".join([line(9, readers.V2_COLUMNS), "short"]))
    e = readers.events_of_lines(readers.expand_zip_archives(spark, str(tmp_path)))
    assert [r.global_event_id for r in e.collect()] == ["9"]


def test_archive_of_a_whole_number_of_blocks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("A.CSV", "\n".join(map(str, range(20_000))))
        z.writestr("empty.txt", "")
        z.writestr("other.bin", "no")
    assert readers.expand_zip_archives(spark, str(tmp_path)).count() == 20_000


def test_polecat(spark, tmp_path):
    head = "Event Date\tCountry\tEvent Type\tQuad Code\tEvent Intensity\n"
    (tmp_path / "x_2023.txt").write_text(head + "2023-05-01\tUSA\tPROTEST\tVERBAL CONFLICT\t-2.5\n")
    (tmp_path / "x_2024.txt").write_text(head + "2024-05-01\tUSA\tASSAULT\tMATERIAL CONFLICT\t\nbad\tUSA\tx\ty\t1\n2024-05-02\tFRA\tAID\tMATERIAL COOPERATION\t7\n")
    assert readers.read_polecat(spark, str(tmp_path), [2024]).count() == 2
    r = readers.read_polecat(spark, str(tmp_path), [2024], "2024-05-01").first()
    assert (r.event_date, r.event_intensity) == (date(2024, 5, 1), None)


def test_snapshots(spark, tmp_path):
    spark.createDataFrame([("a", 0.1, 0.2)], "country string, f0 double, f1 double").toPandas().to_parquet(tmp_path / "20240101_features.parquet")
    spark.createDataFrame([("a", 0.3)], "country string, protest double").toPandas().to_parquet(tmp_path / "20240115_features.parquet")
    rows = readers.read_feature_snapshots(spark, str(tmp_path)).orderBy("snapshot_date").collect()
    assert [(r.snapshot_date.day, r.protest, r.violence) for r in rows] == [(1, 0.1, 0.2), (15, 0.3, None)]


def test_append_and_upsert(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, date(2024, 1, 1 + i % 3), i) for i in ids], "global_event_id long, event_date date, v int")
    out = str(tmp_path / "facts")
    assert sinks.append_new_events(rows(1, 2, 2), out, None) == 2
    assert sinks.append_new_events(rows(2, 3), out, spark.read.parquet(out)) == 1
    t = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "k string, n int, risk double")
    u = spark.createDataFrame([("a", 9), ("c", 3)], "k string, n int")
    assert sorted(map(tuple, sinks.upsert(t, u, ["k"], ["n"]).collect())) == [("a", 9, 0.5), ("b", 2, None), ("c", 3, None)]
    path = str(tmp_path / "t")
    t.withColumn("m", F.lit("x")).unionByName(t.withColumn("m", F.lit("y"))).write.partitionBy("m").parquet(path)
    sinks.write_upsert(path, u.withColumn("m", F.lit("x")), ["k", "m"], ["n"], ["m"])
    got = spark.read.parquet(path)
    assert got.count() == 5 and got.filter("m = 'x' and k = 'a'").first().n == 9 and got.filter("m = 'y' and k = 'a'").first().n == 1


def test_ledger_errors_are_cut(spark):
    ledger = spark.createDataFrame([("u", None, "pending", 0, None)], "file_url string, file_ts timestamp, status string, events long, error string")
    r = sinks.mark_files(ledger, spark.createDataFrame([("u", "error", 0, "e" * 900)], "file_url string, status string, events long, error string")).first()
    assert r.status == "error" and len(r.error) == 500


def test_stream_ingests_once(spark, tmp_path):
    landed, out, audit, state = (str(tmp_path / x) for x in ("in", "out", "audit", "state"))
    (tmp_path / "in").mkdir()
    put = lambda name, *ids: (tmp_path / "in" / name).write_text("\n".join(line(i, readers.V1_COLUMNS, sqldate="20240105", action_geo_country_code="US") for i in ids))
    put("a.csv", 1, 2)
    jobs.ingest(jobs.event_lines(spark, landed), out, audit, state).awaitTermination()
    put("b.csv", 2, 3)
    jobs.ingest(jobs.event_lines(spark, landed), out, audit, state).awaitTermination()
    assert sorted(r.global_event_id for r in History(spark, out).read().collect()) == [1, 2, 3]
    assert sorted(r.inserted for r in VersionedTable(spark, audit, []).read().collect()) == [1, 2]


def test_late_rows_are_counted(spark, tmp_path):
    rows = lambda *days: spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00", 1, 1.0) for d in days], "t string, country int, value double").select(F.col("t").cast("timestamp").alias("ts"), "country", "value")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows(1, 20).coalesce(1).write.parquet(path)
    stream = jobs.daily_counts(spark.readStream.schema(rows(1).schema).parquet(path))
    state = str(tmp_path / "state")
    jobs.upsert_batches(stream, out, ["day", "country"], state).awaitTermination()
    rows(2).coalesce(1).write.mode("append").parquet(path)
    q = jobs.upsert_batches(jobs.daily_counts(spark.readStream.schema(rows(1).schema).parquet(path)), out, ["day", "country"], state)
    q.awaitTermination()
    assert jobs.rows_dropped_late(q) == 1


CHECKED = [n for n in catalog_models.ORACLE_SQL if uuid.uuid5(uuid.NAMESPACE_DNS, n).int % 4 == 0]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_sql(name, spark):
    c = duckdb.connect()
    for t in ("events", "nation", "documents", "benchmark", "labels", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog_models.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    expected = c.sql(catalog_models.ORACLE_SQL[name]).project(",".join(f'"{x}"' for x in cols)).fetchall()
    norm = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)) for r in rows)
    assert norm(df.select(*cols).collect()) == norm(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_backfill_reads_context_but_returns_missing_dates_only(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-12')) as event_date")
    cols = {"action_geo_country": "'X'", "actor1_country": "'X'", "actor2_country": "'Y'", "event_root_code": "19", "event_base_code": "190", "quad_class": "4", "goldstein": "-5.0d", "num_mentions": "7", "avg_tone": "-12.0d"}
    events = days.select("event_date", *[F.expr(v).alias(k) for k, v in cols.items()])
    done = spark.sql("select date'2024-01-09' as feature_date")
    got = {r.label_date.day: r for r in jobs.backfill_labels(events, done, "2024-01-08", "2024-01-10").collect()}
    whole = {r.label_date.day: r for r in labels.multitask_labels(events).collect()}
    assert sorted(got) == [8, 10] and all(got[d].asDict() == whole[d].asDict() for d in got)
    assert sorted(r.cluster_date.day for r in jobs.backfill_clusters(events, done, "2024-01-08", "2024-01-10").collect()) == [8, 10]


def test_forecaster_learns_every_step_before_the_cut(spark):
    rows = [(f"c{i % 7}", s, *[float((i * k) % 5) for k in range(1, 7)]) for i in range(30) for s in range(6, 16)]
    pairs = spark.createDataFrame(rows, "country string, step int, c1 double, c2 double, c3 double, c4 double, c5 double, c6 double")
    # after step 12 the targets lie elsewhere; a model that saw them would be far off
    pairs = pairs.select("*", *[(F.col("c6") * k + F.when(F.col("step") > 8, 100).otherwise(0)).alias(f"t{k}") for k in range(1, 5)])
    model = scoring.fit_forecaster(scoring.before_cut(pairs, 12))
    worst = model.transform(pairs.filter("step <= 8")).agg(F.max(F.greatest(*[F.abs(F.col(f"p{k}") - F.col(f"t{k}")) for k in range(1, 5)]))).first()[0]
    assert worst < 0.3


def test_lines_land_compressed_in_files_of_bounded_length(spark, tmp_path):
    from pathlib import Path

    from tidewatch.sources import sinks

    lines = spark.range(1000).selectExpr("concat(id, repeat('u', 1000)) as line").coalesce(1)
    sinks.write_lines(lines, f"file://{tmp_path}/out", 300)
    files = list(Path(tmp_path, "out").glob("*.gz"))
    assert len(files) == 4 and sum(f.stat().st_size for f in files) < 100_000
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()) == sorted(r.line for r in lines.collect())


@pytest.mark.parametrize("name, batches", [("x1_x2_streaming_ingest", 2), ("x2_latest_first", None)])
def test_streams_land_compressed_lines(spark, tmp_path, monkeypatch, name, batches):
    from pathlib import Path

    folders = [f"file://{tmp_path}/{n}" for n in ("landed", "out", "audit", "state")]
    for times in (1, 3) if batches else (1,):  # with more events than LANDED_EVENTS more files, not longer ones, in as many batches
        made = iter([f"{f}{times}" for f in folders])
        monkeypatch.setattr(catalog_models, "scratch", lambda s: next(made))
        monkeypatch.setattr(catalog_models, "LANDED_EVENTS", -(-spark.read.parquet(f"{SF}/events.parquet").count() // times), raising=False)
        got = catalog_models.QUERIES[name](spark, SF)
        files = list(Path(tmp_path, f"landed{times}").glob("part-*"))
        assert all(f.name.endswith(".gz") for f in files) and sum(f.stat().st_size for f in files) < 100_000
        text = sum(len(r.value) for r in spark.read.text(f"{folders[0]}{times}").collect())
        assert text > 500_000
        expected = catalog_models.facts(spark, SF).count()
        assert 0 < got.count() < expected and got.distinct().count() == got.count()
        if batches:
            assert len(files) == 4 * times and len(list(Path(tmp_path, f"state{times}", "commits").glob("[0-9]*"))) == batches
