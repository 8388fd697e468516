"""Filters, summaries, coverage, gaps, set algebra and snapshots over a corpus of papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import col, normalize_label, topic_tokens


def year_open(year: Column | str, lo: int | None, hi: int | None) -> Column:
    """Year bounds that rows without a year (null or 0) pass."""
    y, ok = col(year), F.lit(True)
    none = y.isNull() | (y == 0)
    if lo is not None:
        ok = ok & (none | (y >= lo))
    if hi is not None:
        ok = ok & (none | (y <= hi))
    return F.coalesce(ok, F.lit(True))


def year_closed(year: Column | str, lo: int | None, hi: int | None) -> Column:
    """Year bounds that rows without a year fail."""
    y = col(year)
    return F.coalesce((y != 0) & (F.lit(True) if lo is None else y >= lo) & (F.lit(True) if hi is None else y <= hi), F.lit(False))


def search_metadata(papers: DataFrame, title: str | None = None, year_min=None, year_max=None, collection=None, item_type=None) -> DataFrame:
    out = papers.where(year_open("year", year_min, year_max))
    if title:
        out = out.where(F.contains(F.lower("title"), F.lit(title.lower())))
    if collection:
        out = out.where(F.array_contains("collections", collection))
    return out.where(F.col("item_type") == item_type) if item_type else out


def filter_papers(papers: DataFrame, collections=None, tags=None, year_min=None, year_max=None, has_file=None) -> DataFrame:
    out = papers
    if collections:
        out = out.where(F.arrays_overlap("collections", F.lit(list(collections))))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.lit(list(tags))))
    if year_min is not None or year_max is not None:
        out = out.where(year_closed("year", year_min, year_max))
    return out.where(F.col("pdf_path").isNotNull() == has_file) if has_file is not None else out


def is_extractable(kind: Column | str, words: Column | str, pages: Column | str, min_words: int = 500, min_pages: int = 2) -> Column:
    """Unknown counts pass."""
    return (F.coalesce(col(kind), F.lit("")) != "non_academic") & F.coalesce(col(words) >= min_words, F.lit(True)) & F.coalesce(col(pages) >= min_pages, F.lit(True))


def count_by(papers: DataFrame, key: Column | str, top: int | None = None, missing: str = "unknown") -> DataFrame:
    """key, n; the most frequent first, ties by key."""
    out = papers.groupBy(F.coalesce(col(key).cast("string"), F.lit(missing)).alias("key")).agg(F.count("*").alias("n"))
    return out.orderBy(F.col("n").desc(), "key").limit(top) if top else out


def coverage(answers: DataFrame, total: int, core: list[str], blank_counts: bool = False) -> DataFrame:
    """answers (paper_id, dimension, value) -> answered, coverage, tier, missing core dimensions."""
    v = F.col("value")
    given = v.isNotNull() if blank_counts else v.isNotNull() & (v != "")
    held = answers.groupBy("paper_id").agg(
        F.count_if(given).alias("answered"),
        *[F.coalesce(F.bool_or(given & (F.col("dimension") == c)), F.lit(False)).alias(f"__{c}") for c in core],
    )
    share = F.col("answered") / total
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"__{c}"), c) for c in core])), ",")
    out = held.withColumn("coverage", share).withColumn("missing_core", missing).drop(*[f"__{c}" for c in core])
    return out.withColumn("tier", coverage_tier("coverage"))


def coverage_tier(share: Column | str) -> Column:
    return F.when(col(share) >= 0.85, "full").when(col(share) >= 0.60, "partial").when(col(share) >= 0.30, "sparse").otherwise("minimal")


def topic_counts(rows: DataFrame, field: str, evidence: int = 3) -> DataFrame:
    """rows (pos, paper_id, field) -> label, n, evidence (first papers in order, joined)."""
    each = rows.select("pos", "paper_id", F.explode(F.split(field, "[,;]")).alias("raw")).withColumn("label", normalize_label("raw")).where("label <> ''")
    first = each.groupBy("label", "paper_id").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy("pos", "paper_id")
    ranked = first.withColumn("__r", F.row_number().over(w))
    return ranked.groupBy("label").agg(
        F.sum("n").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__r") <= evidence, F.struct("__r", "paper_id")))), lambda s: s["paper_id"]), ",").alias("evidence"),
    )


def nearest_rank(counts: DataFrame, value: str, q: float) -> DataFrame:
    """The value at index round((n - 1) q), half to even, of the sorted values: one row `threshold`. Only distinct values meet in a task; of counts there are at most about the square root of twice their sum."""
    hist = counts.groupBy(value).agg(F.count("*").alias("__c"))
    run = hist.withColumn("__end", F.sum("__c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__c").over(Window.partitionBy()))
    at = F.bround((F.col("__all") - 1) * q)
    return run.where(F.col("__end") > at).agg(F.min(value).alias("threshold"))


def gap_confidence(n: Column, threshold: Column, evidence: Column, corpus: Column) -> Column:
    signal = F.greatest(F.lit(0.0), 1 - n / threshold)
    return F.round(F.least(0.5 * signal + 0.3 * F.least(evidence / 3, F.lit(1.0)) + 0.2 * F.least(corpus / 50, F.lit(1.0)), F.lit(1.0)), 3)


def underrepresented(counts: DataFrame, corpus_size: Column, min_count: int = 2, q: float = 0.2, most: int = 10) -> DataFrame:
    """Labels seen at most max(min_count, quantile) times, rarest first."""
    limit = nearest_rank(counts, "n", q).select(F.greatest("threshold", F.lit(min_count)).alias("threshold"))
    low = counts.join(F.broadcast(limit)).where(F.col("n") <= F.col("threshold"))  # one row
    ev = F.size(F.split("evidence", ","))
    return low.withColumn("confidence", gap_confidence(F.col("n"), F.col("threshold"), ev, corpus_size)).orderBy("n", "label").limit(most)


def missing_values(values: DataFrame, name: str) -> DataFrame:
    """Whole numbers between the smallest and the largest value that do not occur."""
    ends = values.agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    return ends.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(name)).join(values, name, "left_anti")


def numbered(values: DataFrame, name: str, out: str, ranges: int = 1024) -> DataFrame:
    """Distinct whole numbers with their place in order: places inside ranges of values plus the counts of earlier ranges, so no task holds them all."""
    lo, hi = values.agg(F.min(name), F.max(name)).first()
    width = max(1, ((hi or 0) - (lo or 0)) // ranges + 1)
    keyed = values.withColumn("__b", F.floor((F.col(name) - F.lit(lo or 0)) / width))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("__b").agg(F.count("*").alias("__before"))
    before = counts.select("__b", F.coalesce(F.sum("__before").over(earlier), F.lit(0)).alias("__before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(name))
    return keyed.withColumn("__r", inside).join(F.broadcast(before), "__b").withColumn(out, F.col("__r") + F.col("__before")).drop("__b", "__r", "__before")


def islands(values: DataFrame, name: str) -> DataFrame:
    """Runs of consecutive numbers: start, end, length. Anti joins find the values that begin or end a run; only those are numbered and paired."""
    v = values.select(F.col(name).alias("v")).distinct()
    starts = v.join(v.select((F.col("v") + 1).alias("v")), "v", "left_anti")
    ends = v.join(v.select((F.col("v") - 1).alias("v")), "v", "left_anti")
    n = lambda df, out: numbered(df.select(F.col("v").alias(out)), out, "__n")
    return n(starts, "start").join(n(ends, "end"), "__n").drop("__n").withColumn("length", F.col("end") - F.col("start") + 1)


def token_lists(rows: DataFrame, text: str) -> DataFrame:
    """paper_id, tokens: those of each row once."""
    return rows.select("paper_id", F.array_distinct(topic_tokens(text)).alias("tokens"))


def token_index(rows: DataFrame, text: str) -> DataFrame:
    """token, paper_id: each once."""
    return token_lists(rows, text).select("paper_id", F.explode("tokens").alias("token"))


def directions(rows: DataFrame, field: str, first_tokens: int = 4) -> DataFrame:
    """Sentences grouped by normal form: direction (first seen), mentions, its first tokens."""
    each = rows.select("pos", "paper_id", F.posexplode(F.split(field, r"\.\s+")).alias("i", "part")).withColumn("part", F.trim("part")).where("part <> ''")
    return (
        each.withColumn("norm", normalize_label("part"))
        .groupBy("norm")
        .agg(F.min_by("part", F.struct("pos", "i")).alias("direction"), F.count_distinct("paper_id").alias("mentions"))
        .withColumn("tokens", F.slice(topic_tokens("direction"), 1, first_tokens))
    )


#: Tokens of papers in one task, token sets that meet them at once, and papers of a bitmap.
INDEX_ROWS, SET_ROWS, MAP_PAPERS = 4_000_000, 4_000_000, 2048


def direction_coverage(found: DataFrame, index: DataFrame) -> DataFrame:
    """found (norm, tokens) with `covered`: papers that hold all the tokens (relational division). index: paper_id and token, or tokens.

    Papers are dealt to groups. A task keeps a bitmap of papers for each token, MAP_PAPERS at a time, and a set's papers are the bits that its tokens'
    maps share, so nothing is made for a set and a paper that meet. Sets go to each group as hashes (XXH64 of tokens), with a count coming back;
    only as many groups as there are cores get theirs at once, so that the sets on disk grow with their number alone.
    """
    from lumenarc.sources.store import staged

    spark = found.sparkSession
    own = F.array_sort(F.array_distinct("tokens"))
    hashes = F.transform(own, lambda t: F.xxhash64(t))
    sets = staged(spark, found.select(F.xxhash64(own).alias("k"), hashes.alias("set")).where("size(set) > 0").distinct(), "token-sets")
    words = F.array("token") if "token" in index.columns else F.col("tokens")
    held = index.select(F.xxhash64("paper_id").alias("p"), F.transform(words, lambda t: F.xxhash64(t)).alias("t")).where("size(t) > 0")
    held = staged(spark, held, "token-index")
    at_once = spark.sparkContext.defaultParallelism
    groups = max(at_once, -(-(held.agg(F.sum(F.size("t"))).first()[0] or 0) // INDEX_ROWS))
    parts = max(1, -(-sets.count() // SET_ROWS))
    sets = sets.withColumn("s", F.pmod("k", F.lit(parts)))
    held = held.withColumn("g", F.pmod(F.xxhash64(F.lit(17), "p"), F.lit(groups)))
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))

    def count(asked, rows):
        import numpy as np
        import pyarrow as pa

        lists = asked.column("set").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        known, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        table = np.full((len(sizes), sizes.max(initial=1)), len(known))  # a set's tokens, filled up with one that all papers hold
        table[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = code
        total = np.zeros(len(sizes), np.int64)
        words = rows.column("t").combine_chunks()
        token, paper = words.flatten().to_numpy(), np.repeat(np.unique(rows.column("p").to_numpy(), return_inverse=True)[1], np.diff(words.offsets.to_numpy()))
        place = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
        used = known[place] == token if len(known) else np.zeros(len(token), bool)
        place, paper = place[used], paper[used]
        order = np.argsort(paper, kind="stable")
        place, paper = place[order], paper[order]
        for first in range(0, int(paper[-1]) + 1 if len(paper) else 0, MAP_PAPERS):
            b, e = np.searchsorted(paper, [first, first + MAP_PAPERS])
            here, at = np.unique(place[b:e], return_inverse=True)
            off = paper[b:e] - first
            bits = np.zeros((len(here) + 1, MAP_PAPERS // 64), np.uint64)
            np.bitwise_or.at(bits, (at, off >> 6), np.uint64(1) << (off & 63).astype(np.uint64))
            bits[-1] = np.uint64(0xFFFFFFFFFFFFFFFF)
            row = np.full(len(known) + 1, -1)
            row[here], row[-1] = np.arange(len(here)), len(here)
            full = np.flatnonzero((row[table] >= 0).all(1))
            for i in range(0, len(full), 65536):
                some = full[i : i + 65536]
                both = bits[row[table[some, 0]]]
                for c in range(1, table.shape[1]):
                    both &= bits[row[table[some, c]]]
                total[some] += np.bitwise_count(both).sum(1, dtype=np.int64)
        hit = np.flatnonzero(total)
        return pa.table({"k": asked.column("k").combine_chunks().take(pa.array(hit)), "n": total[hit]})

    def counted(first: int) -> DataFrame:
        """k, n of the groups from `first` on that are dealt with at once."""
        last = min(first + at_once, groups) - 1
        left = sets.withColumn("g", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        right = held.where(F.col("g").between(first, last)).withColumn("s", slices)
        return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(count, "k long, n long")

    *done, last = range(0, groups, at_once)
    each = [staged(spark, counted(first).groupBy("k").agg(F.sum("n").alias("n")), "covered") for first in done]
    counts = reduce(DataFrame.unionByName, each, counted(last)).groupBy("k").agg(F.sum("n").alias("covered"))
    return found.withColumn("k", F.xxhash64(own)).join(counts, "k", "left").drop("k").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, mark: str, forced: DataFrame | None = None) -> DataFrame:
    """key, change: new, modified, deleted or unchanged; forced keys that still exist are modified."""
    b, a = before.select(key, F.col(mark).alias("__b")), after.select(key, F.col(mark).alias("__a"))
    both = b.withColumn("__in_b", F.lit(True)).join(a.withColumn("__in_a", F.lit(True)), key, "full_outer")
    change = F.when(F.col("__in_b").isNull(), "new").when(F.col("__in_a").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified").otherwise("unchanged")
    out = both.select(key, change.alias("change"))
    if forced is not None:
        out = out.join(forced.select(key).distinct().withColumn("__f", F.lit(True)), key, "left")
        out = out.withColumn("change", F.when(F.col("__f").isNotNull() & (F.col("change") == "unchanged"), "modified").otherwise(F.col("change"))).drop("__f")
    return out


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new)


def keep_last(rows: DataFrame, key: str, pos: str, ties: list[str] | None = None, keyless: bool = False) -> DataFrame:
    """Later duplicates of a key replace earlier ones; rows without a key go, or with `keyless` share one. Of rows of one pos the first by the columns `ties` stays."""
    w = Window.partitionBy(key).orderBy(F.col(pos).desc(), *(ties or []))
    return (rows if keyless else rows.where(F.col(key).isNotNull())).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (dimension, section, question, enabled): what happened to each dimension."""
    o = old.select("dimension", F.col("section").alias("os"), F.col("question").alias("oq"), F.col("enabled").alias("oe"))
    n = new.select("dimension", F.col("section").alias("ns"), F.col("question").alias("nq"), F.col("enabled").alias("ne"))
    both = o.join(n, "dimension", "full_outer")
    change = (
        F.when(F.col("oe").isNull(), "added")
        .when(F.col("ne").isNull(), "removed")
        .when(F.col("oe") & ~F.col("ne"), "disabled")
        .when(~F.col("oq").eqNullSafe(F.col("nq")) | ~F.col("os").eqNullSafe(F.col("ns")), "reworded")
        .otherwise("same")
    )
    return both.select("dimension", change.alias("change"), F.coalesce("ns", "os").alias("section"))
