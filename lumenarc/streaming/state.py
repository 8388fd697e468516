"""Keyed state in streams: a ledger of tries with due retries, a set of keys seen, commits by batch, pauses.

State lives in Spark's state store (RocksDB) under the query's checkpoint, so a stream that is started again goes on from where it
was. Results go to a table log batch by batch; each commit names its batch, and a batch that Spark repeats after a crash is not
committed twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenarc.sources.log import Conflict, TableLog, names_in, read_bytes
from lumenarc.sources.store import replace_file

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "paper_id string, status string, failures long, tries long, due long"
HOLDS = "status string, pos long, failures long, tries long"


class TryLedger(StatefulProcessor):
    """Keeps each paper's last status (by pos), its failures and tries; a failed paper's retry falls due after a wait that doubles with each failure, at most `retries` times.

    Emits the paper's row after each batch that names it, with `due` null, and a row with `due` set (milliseconds) when a retry falls due.
    """

    def __init__(self, wait_ms: int, retries: int):
        self.wait_ms, self.retries = wait_ms, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HOLDS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, pos, failures, tries = self.held.get() if self.held.exists() else (None, None, 0, 0)
        for r in rows:
            tries += 1
            failures += r["status"] == "failed"
            if pos is None or r["pos"] >= pos:
                status, pos = r["status"], r["pos"]
        self.held.update((status, pos, failures, tries))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if status == "failed" and failures <= self.retries:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms * 2 ** (failures - 1))
        yield Row(paper_id=key[0], status=status, failures=failures, tries=tries, due=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        status, _, failures, tries = self.held.get()
        yield Row(paper_id=key[0], status=status, failures=failures, tries=tries, due=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


class SeenKeys(StatefulProcessor):
    """Lets the first row of each key pass; a key is forgotten keep_ms after it was first seen (0: never)."""

    def __init__(self, columns: list[str], keep_ms: int):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.keep_ms or None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))
        if not self.seen.exists():
            self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield Row(**{c: first[c] for c in self.columns})

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def try_ledger(events: DataFrame, wait_ms: int = 60_000, retries: int = 3) -> DataFrame:
    """events: a stream of paper_id (string), status, pos. LEDGER's columns."""
    with_state_store(events.sparkSession)
    return events.select("paper_id", "status", F.col("pos").cast("long").alias("pos")).groupBy("paper_id").transformWithState(TryLedger(wait_ms, retries), LEDGER, "Update", "ProcessingTime")


def unseen_stream(rows: DataFrame, key: str, keep_ms: int = 0) -> DataFrame:
    """A stream's rows whose key (string) was not seen in it before; of a batch's rows of one key the least."""
    with_state_store(rows.sparkSession)
    return rows.groupBy(key).transformWithState(SeenKeys(rows.columns, keep_ms), rows.schema, "Append", "ProcessingTime")


def commit_to(log: TableLog, name: str, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of a batch take the place of those with their keys, once, whatever Spark repeats. name: the stream's."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = TableLog(batch.sparkSession, log.root)
        while True:
            state = held.state()
            if state.meta.get(name, -1) >= batch_id:
                return
            rows = prepare(batch)
            try:
                held.replace(rows, rows, key, seen=state.version, meta={name: batch_id})
                return
            except Conflict:  # another writer came between; its rows stay, ours are tried again
                continue

    return write


class Control:
    """A file that tells a run to pause or to go on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def pause(self, why: str = "") -> None:
        replace_file(self.spark, self.path, json.dumps({"paused": True, "why": why}).encode())

    def resume(self) -> None:
        replace_file(self.spark, self.path, json.dumps({"paused": False}).encode())

    @property
    def paused(self) -> bool:
        folder, _, name = self.path.rpartition("/")
        return name in names_in(self.spark, folder) and bool(json.loads(read_bytes(self.spark, self.path)).get("paused"))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, control: Control | None = None) -> bool:
    """Works off what the source holds, batch by batch, until done (True) or until the control file says pause, which is asked between batches (False).

    A paused run leaves its batch uncommitted, so the next run takes it up again.
    """

    class Paused(Exception):
        pass

    def gated(batch: DataFrame, batch_id: int) -> None:
        if control is not None and control.paused:
            raise Paused
        write(batch, batch_id)

    conf, empty = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    held = conf.get(empty)
    conf.set(empty, "false")  # timers would ask for batch after batch
    try:
        query = stream.writeStream.foreachBatch(gated).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(empty, held)
    try:
        query.awaitTermination()
        return True
    except Exception:
        if control is not None and control.paused:
            return False
        raise
