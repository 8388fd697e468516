import time

import pytest
from pyspark.sql import functions as F

from lumenarc.sources.log import TableLog
from lumenarc.streaming import state as ST
from lumenarc.streaming import sync as SY

SCHEMA = "paper_id string, status string, pos long"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        source, root, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
        log = TableLog(spark, root)

    Place.log.create(spark.createDataFrame([], ST.LEDGER))
    return Place


def current(rows):
    """A batch's row of each paper: one that names it before one that only falls due."""
    return rows.groupBy("paper_id").agg(F.max_by(F.struct("status", "failures", "tries", "due"), F.struct("tries", F.col("due").isNull())).alias("r")).select("paper_id", "r.*")


def run(spark, place, control=None, **k):  # every batch has its own file
    return ST.run_available(ST.try_ledger(stream(spark, place.source), **k), ST.commit_to(place.log, "ledger", "paper_id", current), place.checkpoint, control)


ONE = [("a", "failed", 1), ("b", "processed", 2), ("a", "failed", 3)]
TWO = [("a", "processed", 4), ("c", "skipped", 5)]
THREE = [("b", "failed", 6), ("c", "processed", 7)]


def test_a_stream_started_again_equals_the_batch_ledger(spark, place):
    control = ST.Control(spark, f"{place.root}/control.json")
    put(spark, place.source, ONE)
    assert not control.paused and run(spark, place, control, wait_ms=10**9)
    control.pause("enough")
    put(spark, place.source, TWO)
    before = place.log.state().version
    assert control.paused and run(spark, place, control, wait_ms=10**9) is False
    assert place.log.state().version == before
    control.resume()
    put(spark, place.source, THREE)
    assert run(spark, place, control, wait_ms=10**9)
    want = SY.ledger(spark.createDataFrame(ONE + TWO + THREE, SCHEMA)).select("paper_id", "status", "failures", "tries")
    assert sorted(map(tuple, place.log.read().select("paper_id", "status", "failures", "tries").collect())) == sorted(map(tuple, want.collect()))


def test_a_repeated_batch_is_committed_once(spark, place):
    write = ST.commit_to(place.log, "s", "paper_id")
    batch = spark.createDataFrame([("a", "failed", 1, 1, None)], ST.LEDGER)
    write(batch, 0)
    version = place.log.state().version
    write(batch, 0)
    assert place.log.state().version == version
    write(batch, 1)
    assert place.log.state().version == version + 1 and place.log.read().count() == 1


def test_a_failed_paper_falls_due(spark, place):
    put(spark, place.source, [("a", "failed", 1), ("b", "processed", 1), ("c", "failed", 1), ("c", "failed", 2)])
    found = {}
    write = lambda batch, i: found.update({r["paper_id"]: r["failures"] for r in batch.where("due is not null").collect()})
    query = ST.try_ledger(stream(spark, place.source), wait_ms=100, retries=1).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", place.checkpoint).trigger(processingTime="1 second").start()
    end = time.time() + 60
    while not found and time.time() < end:
        time.sleep(0.5)
    query.stop()
    assert found == {"a": 1}


def test_keys_seen_before_a_restart_stay_seen(spark, place):
    got = []
    write = lambda batch, i: got.extend(map(tuple, batch.collect()))
    for rows in (ONE, TWO, THREE):
        put(spark, place.source, rows)
        ST.run_available(ST.unseen_stream(stream(spark, place.source), "paper_id"), write, place.checkpoint)
    assert sorted(r[0] for r in got) == ["a", "b", "c"]
    assert {r[2] for r in got} == {1, 2, 5}
