"""Incremental state and event-time windows (STM) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarc.plans.inputs import papers, table
from lumenarc.streaming import events as EV
from lumenarc.streaming import sync as SY


def seconds(df, *names):
    return df.withColumns({n: F.unix_timestamp(n) for n in names})


def stm_01_tumbling(spark, sf):
    return seconds(EV.tumbling(table(spark, sf, "events"), "6 hours"), "start", "end").withColumn("total", F.round("total", 4))


def stm_01_sliding(spark, sf):
    return seconds(EV.tumbling(table(spark, sf, "events"), "2 hours", "1 hour"), "start", "end").select("start", "event_type", "n")


def stm_01_sessions(spark, sf):
    return seconds(EV.sessions(table(spark, sf, "events"), "30 minutes"), "start", "end")


def stm_02(spark, sf):
    from lumenarc.operators.corpus import snapshot_diff

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("mark"))
    diff = snapshot_diff(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 <> 1"), "o_orderkey", "mark")
    pending = o.where("o_orderkey % 97 = 5").select(F.lit("embeddings").alias("stage"), F.col("o_orderkey").alias("paper_id"))
    held = {"schema": 1, "embedding": "a", "extraction": "x"}
    runs = {
        "as it is": (held, held, {}),
        "other embedding": (held, held | {"embedding": "b"}, {}),
        "other embedding, update": (held, held | {"embedding": "b"}, {"requested": "update"}),
        "other extraction, new only": (held, held | {"extraction": "y"}, {"limit": "new"}),
        "no manifest": ("missing", held, {}),
    }
    out = None
    for name, (manifest, wanted, more) in runs.items():
        plan = SY.plan_sync(manifest, wanted, diff, pending, **more)
        row = plan.changes.groupBy("change").agg(F.count("*").alias("n")).where("change <> 'unchanged'")
        row = row.select(F.lit(name).alias("run"), F.lit(plan.mode).alias("mode"), F.lit(plan.noop).alias("noop"), F.lit(len(plan.reasons)).alias("reasons"), F.lit(len(plan.advisories)).alias("advisories"), "change", "n")
        out = row if out is None else out.unionByName(row)
    return out


def stm_03(spark, sf):
    li = table(spark, sf, "lineitem")
    row = lambda c: li.where(c).select(F.col("l_returnflag").alias("stage"), F.col("l_orderkey").alias("paper_id"))
    return SY.pending_work(row("l_linenumber <= 3").distinct(), row("l_linestatus = 'F'").distinct(), row("l_quantity > 45"))


def stm_04(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("paper_id"), F.when(F.col("event_type") == "click", "failed").otherwise("processed").alias("status"), F.col("event_id").alias("pos"))
    return SY.ledger(e)


def stm_04_resume(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("paper_id"), F.when(F.col("event_type") == "click", "failed").otherwise("running").alias("status"), F.col("event_id").alias("pos"))
    return SY.resume(c, SY.ledger(e))


def stm_04_stream(spark, sf):
    """The events as a stream of tries through keyed state into a transaction log; equals the batch ledger."""
    import uuid

    from lumenarc.sources.log import TableLog
    from lumenarc.sources.store import shared_folder
    from lumenarc.streaming import state as T

    path, root = f"{sf}/events.parquet", f"{shared_folder(spark)}/lumenarc/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/event[s].parquet")  # a pattern, since the table may be one file
    status = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 3 == 0, "skipped").otherwise("processed")
    tries = events.select(F.concat(F.lit("p"), "user_id").alias("paper_id"), status.alias("status"), F.col("event_id").alias("pos"))
    log = TableLog(spark, f"{root}/log")
    log.create(spark.createDataFrame([], T.LEDGER))
    T.run_available(T.try_ledger(tries, wait_ms=10**9), T.commit_to(log, "tries", "paper_id"), f"{root}/checkpoint")
    return log.read().select("paper_id", "status", "failures", "tries")


def stm_05(spark, sf):
    return SY.history(table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus"))


def stm_06(spark, sf):
    p = papers(spark, sf).select("paper_id")
    fresh, _ = SY.unseen(p, p.where("paper_id like '%7%'"))
    return fresh


def stm_08(spark, sf):
    p = table(spark, sf, "part")
    row = lambda v: p.select(F.concat(F.lit("p"), F.col("p_partkey") % 50).alias("paper_id"), F.concat(F.lit("d"), "p_partkey").alias("dimension"), F.col("p_brand").alias("section"), v.alias("value"))
    changed = p.where("p_size > 48").select(F.col("p_brand").alias("section"))
    return SY.backfill(row(F.col("p_name")), row(F.lower("p_type")), changed)


def stm_09(spark, sf):
    p = papers(spark, sf).select("paper_id", F.when(F.col("pos") % 20 != 0, F.col("text")).alias("text"), "pos")
    return SY.batch_plan(p, p.where("pos % 3 = 0"), p.where("pos % 4 = 0"))


def stm_10(spark, sf):
    p = papers(spark, sf).select("paper_id", "pos", "item_type")
    index = p.where("pos % 2 = 0").select("paper_id", F.when(F.col("pos") % 6 != 0, F.lit("old")).alias("document_type"))
    return SY.classification_update(index, p.where("pos % 5 <> 0"), lambda todo: todo.select("paper_id", F.col("item_type").alias("document_type")))


SESSIONS = "o AS (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, event_id FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE OR ts - p = INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)"
BUCKET = "CAST(floor(epoch(ts) / {0}) * {0} AS BIGINT)"

QUERIES = {
    "stm_01_tumbling_windows": (stm_01_tumbling, f"SELECT {BUCKET.format(21600)} AS start, {BUCKET.format(21600)} + 21600 AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stm_01_sliding_windows": (stm_01_sliding, f"SELECT {BUCKET.format(3600)} - 3600 * i AS start, event_type, count(*) AS n FROM events, range(2) r(i) GROUP BY ALL"),
    "stm_01_session_windows": (stm_01_sessions, f"WITH {SESSIONS} SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS \"end\", count(*) AS n FROM s GROUP BY user_id, k"),
    "stm_02_plan_sync": (stm_02, "WITH r AS (SELECT * FROM (VALUES ('as it is', 'update', 0, 0, true), ('other embedding', 'full', 1, 0, true), ('other embedding, update', 'invalid', 1, 0, true), ('other extraction, new only', 'update', 0, 1, false), ('no manifest', 'full', 1, 0, true)) r(run, mode, reasons, advisories, every)), c AS (SELECT 'new' AS change, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'deleted', count(*) FROM orders WHERE o_orderkey % 10 = 1) SELECT run, mode, false AS noop, CAST(reasons AS INTEGER) AS reasons, CAST(advisories AS INTEGER) AS advisories, change, n FROM r, c WHERE n > 0 AND (every OR change = 'new')"),
    "stm_03_pending_work": (stm_03, "SELECT stage, paper_id FROM (SELECT DISTINCT l_returnflag AS stage, l_orderkey AS paper_id FROM lineitem WHERE l_linenumber <= 3 EXCEPT SELECT l_returnflag, l_orderkey FROM lineitem WHERE l_linestatus = 'F') UNION SELECT l_returnflag, l_orderkey FROM lineitem WHERE l_quantity > 45"),
    "stm_04_ledger": (stm_04, "SELECT user_id AS paper_id, CASE WHEN arg_max(event_type, event_id) = 'click' THEN 'failed' ELSE 'processed' END AS status, count(*) FILTER (event_type = 'click') AS failures, count(*) AS tries FROM events GROUP BY 1"),
    "stm_04_07_resume": (stm_04_resume, "SELECT c_custkey AS paper_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) = 'click')"),
    "stm_04_stream_ledger": (stm_04_stream, "SELECT 'p' || user_id AS paper_id, arg_max(CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'skipped' ELSE 'processed' END, event_id) AS status, count(*) FILTER (event_id % 5 = 0) AS failures, count(*) AS tries FROM events GROUP BY user_id"),
    "stm_05_history": (stm_05, "SELECT o_orderkey AS pos, o_orderstatus FROM orders ORDER BY 1 DESC LIMIT 100"),
    "stm_06_digest_state": (stm_06, "SELECT 'p' || doc_id AS paper_id FROM documents WHERE NOT contains('p' || doc_id, '7')"),
    "stm_08_backfill": (stm_08, "SELECT 'p' || (p_partkey % 50) AS paper_id, 'd' || p_partkey AS dimension, p_brand AS section, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) THEN lower(p_type) ELSE p_name END AS value FROM part"),
    "stm_09_batch_plan": (stm_09, "SELECT 'p' || doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'already extracted' WHEN doc_id % 4 = 0 THEN 'in a running batch' WHEN doc_id % 20 = 0 THEN 'no text' END AS skip FROM documents"),
    "stm_10_classification_index": (stm_10, "SELECT 'p' || doc_id AS paper_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 'old' ELSE lang END AS document_type FROM documents WHERE doc_id % 5 <> 0"),
}
