"""Incremental state: sync plans, ledgers, seen sets, histories, backfills."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.operators.corpus import upsert


#: What a manifest says of the run that wrote it, and why a rebuild is due where that differs from what is wanted.
REBUILDS = {
    "schema": "manifest schema changed",
    "source": "source scope changed",
    "classification": "classification policy changed",
    "embedding": "embedding configuration changed",
    "chunks": "chunk schema changed",
    "overviews": "overview schema changed",
    "similarity": "similarity schema changed",
}
MANIFEST_ERRORS = {"missing": "manifest is missing", "corrupt": "manifest is corrupt"}


@dataclass
class SyncPlan:
    """changes: key, change (new, modified, deleted, unchanged), after the run's limits. mode: full, update or invalid."""

    requested: str
    mode: str
    reasons: list[str]
    advisories: list[str]
    changes: DataFrame
    counts: dict[str, int]
    noop: bool = False
    full_rebuild: bool = False
    clear_vectors: bool = False
    full_extraction: bool = False


def plan_sync(
    manifest: dict | str, wanted: dict, changes: DataFrame, pending: DataFrame | None = None, requested: str = "auto", incremental: bool = True,
    consistent: bool = True, store_problem: str | None = None, targets: int = 0, unmatched: list[str] | None = None, limit: str | None = None,
) -> SyncPlan:
    """What a run has to do.

    manifest, wanted: fingerprints under the keys of REBUILDS and `extraction`; manifest may be `missing` or `corrupt`. pending (stage, paper_id): work that earlier
    runs left. incremental: the source can tell its changes. consistent: the stored tables are those the manifest counts. targets: how many
    papers the run was asked for. limit: `new` or `delete`, changes of other kinds are left out.

    Differences make a full run due; where an update was asked for, the plan is invalid instead. Another extraction set-up is only an advisory. An update with
    neither changes nor pending work is a noop.
    """
    if limit == "new":
        changes = changes.where("change not in ('modified', 'deleted')")
    elif limit == "delete":
        changes = changes.where("change not in ('new', 'modified')")
    reasons = ["source cannot tell its changes"] if requested == "auto" and not incremental else []
    if requested == "update" and not incremental:
        return SyncPlan(requested, "invalid", ["updates need a source that can tell its changes"], [], changes.limit(0), {})
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # four rows
    due, advisories = [], []
    if isinstance(manifest, str):
        due.append(MANIFEST_ERRORS[manifest])
    else:
        due += [why for key, why in REBUILDS.items() if manifest.get(key) != wanted.get(key)]
        if manifest.get("extraction") != wanted.get("extraction"):
            advisories.append(f"extraction set-up differs: {manifest.get('extraction')} before, {wanted.get('extraction')} now; answers are kept")
        due += ([] if consistent else ["stored tables differ from the manifest"]) + ([store_problem] if store_problem else [])
    if unmatched:
        reasons.append("unmatched targets: " + ", ".join(sorted(unmatched)))
    if requested == "update" and due:
        return SyncPlan(requested, "invalid", due + reasons, advisories, changes, counts, full_extraction=not consistent)
    full = requested == "full" or bool(due) or not incremental
    if full and requested != "full":
        reasons = due + reasons
    if targets and requested == "full":
        reasons.append("a full run of named papers only refreshes these")
    touched = any(counts.get(c) for c in ("new", "modified", "deleted"))
    owed = not full and not touched and pending is not None and not pending.isEmpty()
    return SyncPlan(requested, "full" if full else "update", reasons, advisories, changes, counts, noop=not full and not touched and not owed, full_rebuild=full, clear_vectors=full and not targets, full_extraction=not consistent)


def pending_work(state: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """state, done, failed (stage, paper_id): what each stage still owes: what it owed less what is done, and what failed."""
    return state.join(done, ["stage", "paper_id"], "left_anti").unionByName(failed).distinct()


def ledger(events: DataFrame) -> DataFrame:
    """events (paper_id, status, pos): last status and number of tries of each paper."""
    return events.groupBy("paper_id").agg(F.max_by("status", "pos").alias("status"), F.count_if(F.col("status") == "failed").alias("failures"), F.count("*").alias("tries"))


def resume(papers: DataFrame, state: DataFrame, retry_failed: bool = False) -> DataFrame:
    if retry_failed:
        return papers.join(state.where("status = 'failed'"), "paper_id", "left_semi")
    return papers.join(state.where("status in ('processed', 'failed', 'skipped')"), "paper_id", "left_anti")


def unseen(rows: DataFrame, seen: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose key was not seen, and the seen set after them."""
    fresh = rows.join(seen.select(key), key, "left_anti")
    return fresh, seen.select(key).union(fresh.select(key)).distinct()


def history(records: DataFrame, keep: int = 100, by: str = "pos") -> DataFrame:
    """The last `keep` records; a top-k, not a sort of the whole table."""
    return records.orderBy(F.col(by).desc()).limit(keep)


def backfill(old: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """old, fresh (paper_id, dimension, section, value): new values for changed sections only."""
    return upsert(old, fresh.join(F.broadcast(changed.select("section").distinct()), "section", "left_semi").select(*old.columns), ["paper_id", "dimension"])


def batch_plan(papers: DataFrame, done: DataFrame, running: DataFrame) -> DataFrame:
    """paper_id, skip: why a paper is not submitted, null if it is."""
    flag = lambda df, n: df.select("paper_id").distinct().withColumn(n, F.lit(True))
    both = papers.join(flag(done, "__d"), "paper_id", "left").join(flag(running, "__r"), "paper_id", "left")
    return both.select("paper_id", F.when(F.col("__d"), "already extracted").when(F.col("__r"), "in a running batch").when(F.col("text").isNull(), "no text").alias("skip"))


def classification_update(index: DataFrame, papers: DataFrame, classify) -> DataFrame:
    """Records of removed papers go; papers without a complete record are classified."""
    kept = index.join(papers.select("paper_id"), "paper_id", "left_semi")
    todo = papers.join(kept.where("document_type is not null"), "paper_id", "left_anti")
    return upsert(kept, classify(todo), "paper_id")


def recent_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")

