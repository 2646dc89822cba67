"""Writers at the same time, readers during a compaction, and what reaches the scans of the store."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import commits, store


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store"))


def actuals(spark, ticker, days, y=1.0):
    rows = [(ticker, f"2025-{1 + d // 28:02d}-{1 + d % 28:02d}", 1, float(y)) for d in days]
    return spark.createDataFrame(rows, "ticker string, day string, horizon int, y double").select("ticker", F.to_timestamp("day").alias("target_utc"), "horizon", "y")


def at_once(*calls):
    """Run the calls in threads that begin together; what they return, or raise."""
    gate, out = threading.Barrier(len(calls)), [None] * len(calls)

    def run(k, call):
        gate.wait()
        try:
            out[k] = call()
        except Exception as error:
            out[k] = error

    threads = [threading.Thread(target=run, args=x) for x in enumerate(calls)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_writers_take_versions_of_their_own(spark, kept):
    kept.register("ES", {"kind": "es"}, None, "2025-01-01")
    ids = at_once(*(lambda k=k: kept.register("ES", {"k": k}, None, "2025-01-02") for k in range(4)))
    assert sorted(ids) == [f"ES:{n:04d}" for n in (2, 3, 4, 5)]
    assert {r.model_id for r in kept.history("ES").collect()} == {f"ES:{n:04d}" for n in range(1, 6)}
    assert len({kept.model(i)["params_json"] for i in ids}) == 4
    assert kept.register("a/b: c", {}, None, None) == "a/b: c:0001" and kept.register("a/b: c", {}, None, None) == "a/b: c:0002"


def test_writers_at_once_lose_nothing(spark, kept):
    assert not [x for x in at_once(*(lambda k=k: kept.upsert_actuals(actuals(spark, f"T{k}", range(5), k)) for k in range(5))) if isinstance(x, Exception)]
    log = kept.log("actuals")
    assert log.numbers() == [1, 2, 3, 4, 5] and sorted(p.seq for p in log.at()[1]) == [1, 2, 3, 4, 5]
    got = {(r.ticker, r.n, r.y) for r in kept.read("actuals").groupBy("ticker").agg(F.count("*").alias("n"), F.max("y").alias("y")).collect()}
    assert got == {(f"T{k}", 5, float(k)) for k in range(5)}


def test_the_later_commit_counts_not_the_later_clock(spark, kept):
    kept.upsert_actuals(actuals(spark, "A", [3], 1.0))
    old = kept.read("actuals")  # bound to its commit
    kept.upsert_actuals(actuals(spark, "A", [3], 2.0))
    assert [r.y for r in old.collect()] == [1.0] and [r.y for r in kept.read("actuals").collect()] == [2.0]
    assert [r.y for r in kept.read("actuals", at=1).collect()] == [1.0]
    assert kept.upsert("actuals", kept.read("actuals").limit(0)) is None and kept.log("actuals").numbers() == [1, 2]


def test_a_reader_during_a_compaction_sees_one_state(spark, kept, monkeypatch):
    for y in (1.0, 2.0, 3.0):
        kept.upsert_actuals(actuals(spark, "A", range(40), y))
    reader = kept.read("actuals")
    real = kept._write

    def write_then_append(name, rows):  # between the compaction's read and its commit, another writer comes
        folder = real(name, rows)
        monkeypatch.setattr(kept, "_write", real)
        kept.upsert_actuals(actuals(spark, "A", [0], 9.0))
        return folder

    monkeypatch.setattr(kept, "_write", write_then_append)
    assert kept.compact("actuals", ["2025-01-20"]) == 5
    assert {r.y for r in reader.collect()} == {3.0} and reader.count() == 40
    now = {r.target_utc.day: r.y for r in kept.read("actuals", start="2025-01-01", end="2025-01-31").collect()}
    assert len(now) == 28 and now[1] == 9.0 and {y for d, y in now.items() if d != 1} == {3.0}
    assert kept.read("actuals").count() == 40
    january = kept.log("actuals").paths(kept.log("actuals").at()[1], {"month=2025-01-01"})
    assert sorted(january.values()) == [3, 4]  # the compacted rows rank as what they were made of, below what came meanwhile


def test_of_two_compactions_one_counts(spark, kept, monkeypatch):
    for y in (1.0, 2.0):
        kept.upsert_actuals(actuals(spark, "A", range(30), y))
    done = at_once(lambda: kept.compact("actuals", ["2025-01-01"]), lambda: kept.compact("actuals", ["2025-01-01"]))
    assert not [x for x in done if isinstance(x, Exception)] and any(done)
    assert kept.read("actuals").count() == 30 and {r.y for r in kept.read("actuals").collect()} == {2.0}
    base, pieces = kept.log("actuals").at()
    stale = [p for p in pieces if "month=2025-01-01" in p.parts]
    assert len(stale) == 1
    assert kept.log("actuals").replace(2, {"month=2025-01-01"}, stale[0].folder) is None  # made of what no longer is there


def test_vacuum_keeps_what_late_readers_need(spark, kept, tmp_path):
    for y in (1.0, 2.0, 3.0):
        kept.upsert_actuals(actuals(spark, "A", range(5), y))
    kept.compact("actuals", ["2025-01-01"])
    folders = lambda: {p.name for p in (tmp_path / "store" / "actuals").iterdir()}
    assert len(folders()) == 4
    kept.vacuum(keep=2)  # commit 3 still reads all three
    assert len(folders()) == 4 and kept.log("actuals").numbers() == [3, 4]
    kept.vacuum(keep=1)
    assert len(folders()) == 1 and {r.y for r in kept.read("actuals").collect()} == {3.0}


def test_create_is_atomic_by_link_and_by_rename(spark, tmp_path, monkeypatch):
    files = commits.Files(spark, str(tmp_path))
    for link in (files.link, files.rename):
        monkeypatch.setattr(files, "link", link)
        name = f"log/{link.__name__}"
        assert files.create(name, "first é") and not files.create(name, "second")
        assert files.read(name) == "first é"
    assert files.names("log") == ["link", "rename"] and files.names("none") == []
    won = at_once(*(lambda k=k: files.create("log/race", str(k)) for k in range(6)))
    assert sorted(won) == [False] * 5 + [True]


def test_filters_reach_the_scan_below_the_choice_of_rows(spark, kept):
    fitted = spark.createDataFrame([("A", b"x", 0.5, 3), ("B", b"y", 0.25, 4)], "entity_id string, artifact binary, loss double, n long")
    for _ in range(3):
        kept.register("ES", {}, None, "2025-01-01", fitted=fitted)
        kept.register("other", {}, None, "2025-01-01", fitted=fitted)
    got = kept.artifacts("ES:0002")
    assert sorted((r.model_id, r.entity_id, bytes(r.artifact)) for r in got.collect()) == [("ES:0002", "A", b"x"), ("ES:0002", "B", b"y")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(model_id" in scan or "PartitionFilters: [(model_id" in scan
    plan = kept.read("models", model_type=["ES"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(model_type,ES)" in plan or "In(model_type, [ES])" in plan
    with pytest.raises(ValueError, match="not decided"):
        kept.read("models", metric_name=["rmse"])
    kept.compact("artifacts", ["ES:0002"])
    assert kept.artifacts("ES:0002").count() == 2 and kept.read("artifacts").count() == 12
