from datetime import date
from types import SimpleNamespace

import pytest

from tidewatch.sources import history, scratch
from tidewatch.sources.history import History
from tidewatch.sources.versioned import VersionedTable

KIND = "day string, k int, n int, risk double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def target(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["day"])
    assert t.read() is None
    t.append(spark.createDataFrame([("a", 1, 10, 0.5), ("a", 2, 20, None), ("b", 1, 30, 0.7)], KIND))
    return t


def test_upsert_touches_its_partitions_only(spark, target):
    before = target.state()["parts"]
    target.upsert(spark.createDataFrame([("a", 2, 21), ("a", 3, 33), ("c", 9, 9)], "day string, k int, n int"), ["day", "k"], ["n"])
    assert rows(target.read().select("day", "k", "n", "risk")) == [("a", 1, 10, 0.5), ("a", 2, 21, None), ("a", 3, 33, None), ("b", 1, 30, 0.7), ("c", 9, 9, None)]
    after = target.state()["parts"]
    assert after["day=b"] == before["day=b"] and after["day=a"] != before["day=a"]
    assert rows(target.read(0).select("day", "k", "n", "risk")) == [("a", 1, 10, 0.5), ("a", 2, 20, None), ("b", 1, 30, 0.7)]
    with pytest.raises(ValueError):
        target.upsert(spark.createDataFrame([("a", 1)], "day string, n int"), ["n"], [])


def test_write_that_dies_before_its_commit_is_not_seen(spark, target, monkeypatch):
    was = rows(target.read())
    update = spark.createDataFrame([("a", 1, 99)], "day string, k int, n int")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_committed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            target.upsert(update, ["day", "k"], ["n"], "s", 0)
    assert rows(target.read()) == was and target.versions() == [0]
    assert target.upsert(update, ["day", "k"], ["n"], "s", 0)
    assert target.read().filter("day = 'a' and k = 1").first().n == 99
    assert target.vacuum() >= 2 and target.read().count() == 3  # the lost folder and the old one


def test_a_batch_counts_once(spark, target):
    more = spark.createDataFrame([("b", 5, 1, 0.1)], KIND)
    assert target.append(more, "s", 3) and not target.append(more, "s", 3) and not target.append(more, "s", 2)
    assert target.append(more, "other", 3)
    assert target.read().count() == 5


def test_two_writers_of_one_version(spark, target):
    state = target.state()
    target.append(spark.createDataFrame([("b", 5, 1, 0.1)], KIND))
    with pytest.raises(Exception, match="exist"):
        target._committed(state, target.read().schema, state["parts"], None, None)


def test_compact_and_vacuum(spark, target):
    for i in range(3):
        target.append(spark.createDataFrame([("a", 100 + i, i, 0.0)], KIND))
    was = rows(target.read())
    assert target.compact() == 1 and len(target.state()["parts"]["day=a"]) == 1 and rows(target.read()) == was
    assert target.vacuum() == 4 and rows(target.read()) == was and len(target.versions()) == 1
    assert target.compact() == 0


def events(spark, *ids):
    return spark.createDataFrame([(i, date(2024, 1 + i // 1000, 1 + i % 28), i) for i in ids], "global_event_id long, event_date date, v int")


def test_history_takes_each_key_once(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    assert h.append(events(spark, *range(50), 3, 1001, 2001)) == 52 and h.looked_up == ([], 0)
    assert h.append(events(spark, *range(40, 60), 5000)) == 11
    months, n = h.looked_up
    assert months == ["2024-01"] and 10 <= n <= 12  # the months of unknown keys are not read
    assert h.append(events(spark, 6001)) == 1 and h.looked_up == ([], 0)
    assert sorted(r.global_event_id for r in h.read().collect()) == [*range(60), 1001, 2001, 5000, 6001]
    assert h.append(events(spark, *range(60))) == 0


def test_full_sketch_is_still_exact(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h", bits=64)
    assert h.append(events(spark, *range(200))) == 200
    assert h.append(events(spark, *range(150, 300))) == 100 and h.looked_up[1] > 100
    assert h.read().count() == 300


def test_history_broadcasts_nothing_that_grows(spark, tmp_path, monkeypatch):
    plans, real = [], history.materialize
    monkeypatch.setattr(history, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(history, "BROADCAST_ROWS", 5)
    h = History(spark, f"file://{tmp_path}/h")
    h.append(events(spark, *range(50)))
    assert h.append(events(spark, *range(40, 60))) == 10 and h.looked_up[1] >= 10
    assert len(plans) == 6 and "SortMergeJoin" in plans[-1] and not any("Broadcast" in p for p in plans)


def test_history_after_a_crash_between_sketch_and_facts(spark, tmp_path, monkeypatch):
    h = History(spark, f"file://{tmp_path}/h")
    h.append(events(spark, 1, 2), "s", 0)
    with monkeypatch.context() as m:
        m.setattr(h.facts, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            h.append(events(spark, 2, 3), "s", 1)
    assert h.append(events(spark, 2, 3), "s", 1) == 1 and h.append(events(spark, 2, 3), "s", 1) == 0
    assert sorted(r.global_event_id for r in h.read().collect()) == [1, 2, 3]


def test_cluster_without_a_shared_folder_raises():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(SimpleNamespace(conf=Conf()))
