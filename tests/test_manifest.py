import zipfile

import pytest

from tidewatch.sources import readers
from tidewatch.sources.manifest import Member, lines, members, round_files, round_numbers, write_round
from tidewatch.sources.versioned import VersionedTable
from tidewatch.streaming import jobs

URL = "http://files.example/{}.export.CSV.zip"


def line(n):
    return "\t".join({"global_event_id": str(n), "sqldate": "20240105", "action_geo_country_code": "US"}.get(c, "") for c in readers.V2_COLUMNS)


def put(folder, stamp, *ids, members=1):
    with zipfile.ZipFile(folder / f"{stamp}.export.CSV.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for m in range(members):
            z.writestr(f"{m}_{stamp}.export.CSV", "\n".join(line(i) for i in ids[m::members]))


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "files").mkdir()
    stamps = [f"2024010500{i}000" for i in range(5)]
    for k, s in enumerate(stamps):
        put(tmp_path / "files", s, 10 * k + 1, 10 * k + 2, 1)
    (tmp_path / "list.txt").write_text("".join(f"1 h {URL.format(s)}\n" for s in [*stamps[::-1], stamps[0]]) + "1 h http://files.example/x.gkg.csv.zip\n")
    return tmp_path, stamps


def ingest(spark, tmp_path, **options):
    at = lambda name: f"file://{tmp_path}/{name}"
    return jobs.ManifestIngest(spark, at("list.txt"), at("files"), at("out"), **options)


def taken(job):
    return [[u.rsplit("/", 1)[-1][:14] for u in round_files(job.rounds, n)] for n in round_numbers(job.rounds)]


def ledger(job):
    return {r.file_url.rsplit("/", 1)[-1][:14]: r for r in job.ledger.read().collect()}


@pytest.mark.parametrize("latest", [False, True])
def test_rounds_in_order(spark, landed, latest):
    tmp_path, stamps = landed
    job = ingest(spark, tmp_path, latest_first=latest, per_round=2)
    assert job.run() == 2
    order = stamps[::-1] if latest else stamps
    assert taken(job) == [order[:2]] and {s for s, r in ledger(job).items() if r.status == "pending"} == set(order[2:])
    assert job.run_all() == 2 and taken(job) == [order[:2], order[2:4], order[4:]]
    assert sorted(r.global_event_id for r in job.history.read().collect()) == sorted({1} | {10 * k + j for k in range(5) for j in (1, 2)})
    assert sum(r.events for r in ledger(job).values()) == 10 and {r.status for r in ledger(job).values()} == {"done"}
    assert ingest(spark, tmp_path).run() == 0


def test_failed_file_leaves_nothing_and_is_tried_again(spark, landed):
    tmp_path, stamps = landed
    good = (tmp_path / "files" / f"{stamps[1]}.export.CSV.zip").read_bytes()
    at = good.index(b"export.CSV") + 12
    (tmp_path / "files" / f"{stamps[1]}.export.CSV.zip").write_bytes(good[:at] + bytes(8) + good[at + 8 :])  # its directory is whole
    (tmp_path / "files" / f"{stamps[2]}.export.CSV.zip").unlink()
    job = ingest(spark, tmp_path, attempts=2)
    assert job.run() == 5
    found = ledger(job)
    assert [found[s].status for s in stamps] == ["done", "error", "error", "done", "done"] and "No such file" in found[stamps[2]].error and found[stamps[1]].error
    assert not {11, 12} & {r.global_event_id for r in job.history.read().collect()}
    (tmp_path / "files" / f"{stamps[1]}.export.CSV.zip").write_bytes(good)
    assert job.run_all() == 1  # the missing one has failed twice now
    found = ledger(job)
    assert (found[stamps[1]].status, found[stamps[1]].attempts, found[stamps[1]].error) == ("done", 2, None) and (found[stamps[2]].status, found[stamps[2]].attempts) == ("error", 2)
    assert {11, 12} <= {r.global_event_id for r in job.history.read().collect()}


def test_run_that_dies_goes_on_with_its_round(spark, landed, monkeypatch):
    tmp_path, stamps = landed
    job = ingest(spark, tmp_path, per_round=3)
    real = VersionedTable.upsert
    with monkeypatch.context() as m:  # after the events are there, before the ledger says so
        m.setattr(VersionedTable, "upsert", lambda self, rows, keys, cols, *batch: real(self, rows, keys, cols, *batch) if not batch else (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            job.run()
    assert {r.status for r in ledger(job).values()} == {"pending"} and job.history.read().count() == 6
    again = ingest(spark, tmp_path, per_round=3)
    assert again.run() == 3 and taken(again) == [stamps[:3]]
    assert again.history.read().count() == 6 and sum(r.events for r in ledger(again).values()) == 6
    assert again.run_all() == 1


def test_archive_is_read_by_member(spark, tmp_path):
    put(tmp_path, "20240101000000", *range(25_000), members=5)
    parts = members("u", f"{tmp_path}/20240101000000.export.CSV.zip", (".csv",))
    assert len(parts) == 5 and max(b.num_rows for p in parts for b in lines(p)) <= 10_000
    rows = readers.expand_zip_archives(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 5 and readers.events_of_lines(rows).select("global_event_id").distinct().count() == 25_000


def test_unreadable_archive_raises_in_a_batch(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="BadZipFile"):
        readers.expand_zip_archives(spark, str(tmp_path)).count()
    assert [b.column("error")[0].as_py() for b in lines(Member("u", str(tmp_path / "none.csv")))][0].startswith("FileNotFoundError")


def test_round_is_written_once(spark, tmp_path):
    folder = f"file://{tmp_path}/rounds"
    assert round_numbers(folder) == []
    write_round(spark, folder, 1, ["a"])
    with pytest.raises(Exception, match="exist"):
        write_round(spark, folder, 1, ["b"])
    assert round_files(folder, 1) == ["a"]


def test_rounds_are_taken_in_groups(spark, landed):
    tmp_path, stamps = landed
    job = ingest(spark, tmp_path, per_round=1, at_once=3)
    (tmp_path / "files" / f"{stamps[1]}.export.CSV.zip").write_bytes(b"no archive")
    assert job.run_all() == 7 and [len(round_files(job.groups, n)) for n in round_numbers(job.groups)] == [2, 2, 2]
    assert taken(job) == [[s] for s in (*stamps[:3], stamps[1], *stamps[3:], stamps[1])]  # what failed comes first in the next group
    found = ledger(job)
    assert [found[s].status for s in stamps] == ["done", "error", "done", "done", "done"] and found[stamps[1]].attempts == 3
    assert sorted(r.global_event_id for r in job.history.read().collect()) == sorted({1} | {10 * k + j for k in (0, 2, 3, 4) for j in (1, 2)})


def test_rounds_written_before_a_death_are_taken(spark, landed):
    tmp_path, stamps = landed
    job = ingest(spark, tmp_path, per_round=2)
    job.ledger.upsert(job.registered(), ["file_url"], [])
    write_round(spark, job.rounds, 1, [URL.format(s) for s in stamps[:2]])
    assert job.run_all() == 3 and taken(job) == [stamps[:2], stamps[2:4], stamps[4:]] and {r.status for r in ledger(job).values()} == {"done"}


def test_many_small_archives_share_partitions(spark, tmp_path):
    for k in range(70):
        put(tmp_path, f"2024{k:010d}", *range(10 * k, 10 * k + 10), members=2)
    rows = readers.expand_zip_archives(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() < 10 and rows.select("file").distinct().count() == 70
    assert sorted(int(r.global_event_id) for r in readers.events_of_lines(rows).select("global_event_id").collect()) == list(range(700))
    (tmp_path / "x.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="BadZipFile"):
        readers.expand_zip_archives(spark, str(tmp_path)).count()
