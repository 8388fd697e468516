"""Entity resolution: duplicate papers, greedy choices in a fixed order, candidate matching."""

from __future__ import annotations

from collections import deque
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.ids import normalize_doi
from lumenarc.functions.text import col, normalize_title
from lumenarc.operators.graph import components
from lumenarc.sources.store import shared_folder, staged


def survivors(papers: DataFrame, score: Column, skip: list[str] | None = None) -> DataFrame:
    """papers (paper_id, pos, title): survivor of each group of equal titles (best score, then first); blank and `skip` titles stand alone."""
    norm = normalize_title("title")
    alone = (norm == "") | norm.isin(skip or ["untitled"]) | F.col("title").isNull()
    keyed = papers.withColumn("norm", F.when(alone, F.concat(F.lit("\u0000"), F.col("paper_id"))).otherwise(norm)).withColumn("__s", score)
    best = keyed.groupBy("norm").agg(F.min_by("paper_id", F.struct((-F.col("__s")).alias("s"), "pos")).alias("survivor"), F.count("*").alias("group_size"))
    return keyed.select("paper_id", "norm").join(best, "norm").select("paper_id", "survivor", "group_size")


def redirect(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """edges (source, target, rank, ...) with merged papers replaced; no loops; the first edge of each pair stays."""
    m = moved.select("paper_id", "survivor")
    out = edges.join(m.select(F.col("paper_id").alias("source"), F.col("survivor").alias("__s")), "source", "left").join(m.select(F.col("paper_id").alias("target"), F.col("survivor").alias("__t")), "target", "left")
    out = out.withColumn("source", F.coalesce("__s", "source")).withColumn("target", F.coalesce("__t", "target")).drop("__s", "__t").where("source <> target")
    w = Window.partitionBy("source", "target").orderBy("rank")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sequence_ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of two titles, case and outer blanks ignored."""
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def title_ratio(a: Column | str, b: Column | str) -> Column:
    """sequence_ratio of two columns, batch by batch; meant for the few pairs that `similar_titles` leaves."""

    @F.arrow_udf("double")
    def ratio(x, y):
        import pyarrow as pa

        matcher, held, out = SequenceMatcher(None), None, []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            p, q = (p or "").lower().strip(), (q or "").lower().strip()
            if q != held:  # what a second title needs is worked out once
                matcher.set_seq2(q)
                held = q
            matcher.set_seq1(p)
            out.append(matcher.ratio() if p and q else 0.0)
        return pa.array(out, pa.float64())

    return ratio(col(a), col(b))


#: Titles of a block and of a tile, and columns of a title's character and pair counts.
TITLE_ROWS, TITLE_TILE, COUNTS = 4096, 512, 512


def title_counts(titles: list[str]):
    """Counts of the numbered characters (the third e, the first z) and of the character pairs of each title, in COUNTS columns."""
    import numpy as np

    one, two = np.zeros((len(titles), COUNTS), np.float32), np.zeros((len(titles), COUNTS), np.int16)
    for r, t in enumerate(titles):
        seen: dict[str, int] = {}
        for c in t:
            seen[c] = seen.get(c, 0) + 1
            one[r, (ord(c) + 31 * seen[c]) % COUNTS] += 1
        for c, d in zip(t, t[1:]):
            two[r, (37 * ord(c) + ord(d)) % COUNTS] += 1
    return one, two


def longest_common(a: str, places: dict[str, int], b: str) -> int:
    """Length of the longest common subsequence; places: the bits at which each character stands in a."""
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def close_titles(one: list[str], two: list[str], threshold: float, same: bool):
    """Indices of the pairs that may reach the threshold. The ratio is 2 M over both lengths, and M characters stand in both titles in one order: so M is
    at most what bags of characters share, and the longest common subsequence; all but one of each run's characters begin a pair that both have, and there
    are at most as many runs as characters left out, and one. Columns that two characters share only raise what seems shared."""
    import numpy as np

    n1, n2 = (np.array([len(t) for t in side]) for side in (one, two))
    (a1, a2), (b1, b2) = title_counts(one), title_counts(two)
    b1 = np.ascontiguousarray(b1.T)
    for at in range(0, len(one), TITLE_TILE):
        size = n1[at : at + TITLE_TILE, None] + n2
        i, j = np.divmod(np.flatnonzero((2 * (a1[at : at + TITLE_TILE] @ b1) >= threshold * size - 1e-3).ravel()), len(two))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 8192):
            p, q = i[k : k + 8192], j[k : k + 8192]
            size = n1[p] + n2[q]
            least = np.ceil(threshold * size / 2 - 1e-9)
            ok = np.minimum(a2[p], b2[q]).sum(1) >= 3 * least - size - 1
            for x, y in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
                yield x, y


def similar_titles(rows: DataFrame, threshold: float, title: str = "title") -> DataFrame:
    """a, b, ratio: all ordered pairs of different titles (lower case, trimmed) whose ratio reaches the threshold. Blank titles match nothing.

    Blocks of titles meet once each in tasks; what pairs can share at most is worked out for whole tiles (`close_titles`), then by the longest common
    subsequence, and ratios only of what is left. Nothing is lost, only titles and matches are shuffled; the tiles are quadratic in different titles.
    """
    import math

    spark = rows.sparkSession
    titles = staged(spark, rows.select(F.lower(F.trim(F.col(title))).alias("t")).where("t <> ''").distinct(), "titles")
    n = titles.count()
    size = min(TITLE_ROWS, max(256, math.ceil(n / math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    count = max(1, -(-n // size))
    blocks = titles.groupBy(F.pmod(F.xxhash64(F.lit(19), "t"), F.lit(count)).cast("int").alias("b")).agg(F.collect_list("t").alias("t"))  # about `size` titles
    blocks = staged(spark, blocks, "title-blocks")
    left = blocks.select(F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.lit(count - 1))).alias("j"), F.lit(0).alias("side"), "t")
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), "t")

    def match(table):
        import pyarrow as pa

        sides = dict(zip(table.column("side").to_pylist(), table.column("t").to_pylist(), strict=True))
        out = []
        if len(sides) == 2:
            plain = [[t.lower().strip() for t in sides[s]] for s in (0, 1)]
            held, places = None, {}
            for x, y in close_titles(*plain, threshold, table.column("i")[0] == table.column("j")[0]):
                p, q = plain[0][x], plain[1][y]
                if x != held:
                    held, places = x, {}
                    for k, c in enumerate(p):
                        places[c] = places.get(c, 0) | 1 << k
                if p and q and 2 * longest_common(p, places, q) >= threshold * (len(p) + len(q)) - 1e-9:
                    out += [(a, b, r) for a, b in ((sides[0][x], sides[1][y]), (sides[1][y], sides[0][x])) if (r := sequence_ratio(a, b)) >= threshold]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "ratio"])

    return left.unionByName(right).groupBy("i", "j").applyInArrow(match, "a string, b string, ratio double")


#: Rows of a group of similar titles that one task replays in order; larger groups are settled in rounds, of which copies of a title need one each.
REPLAY_ROWS = 1_000_000


def replay(rows: list, similar: dict) -> set:
    """pos of what stays when rows (seat, pos, title, weight) come in order of seat: a late row meets the first row that stayed of those with its title or
    a similar one, and takes its place if it weighs more; else it goes. Others stay when they come. What a row meets is the first of its title."""
    held: dict = {}
    for seat, pos, title, weight in sorted(rows):
        first = [h[0] for t in (title, *similar.get(title, ())) if (h := held.get(t))] if seat[0] else ()
        if first:
            rival = min(first)
            if weight <= rival[3]:
                continue
            held[rival[2]].popleft()
        held.setdefault(title, deque()).append((seat, pos, title, weight))
    return {r[1] for h in held.values() for r in h}


def settle_in_rounds(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The replay for groups of any size. rows: pos, weight; edges: pos, rival (earlier). A row is settled when all earlier rows are that could still
    change what it meets: its rivals, and the rows before it that meet one of them. pos of what stays."""
    spark = rows.sparkSession
    state = staged(spark, rows.join(edges.select("pos").distinct().withColumn("open", F.lit(True)), "pos", "left").select("pos", "weight", F.coalesce("open", F.lit(False)).alias("open"), F.col("open").isNull().alias("kept")), "settled")
    while not state.where("open").isEmpty():
        rival = state.select(F.col("pos").alias("rival"), F.col("weight").alias("w2"), F.col("open").alias("open2"), F.col("kept").alias("kept2"))
        known = edges.join(state, "pos").join(rival, "rival")
        waiting = known.where("open").groupBy("rival").agg(F.min("pos").alias("first"))
        mine = known.where("open").join(waiting, "rival")
        seen = mine.groupBy("pos", "weight").agg(F.bool_and((F.col("first") == F.col("pos")) & ~F.col("open2")).alias("ready"), F.min(F.when(F.col("kept2"), F.struct("rival", "w2"))).alias("meets"))
        done = staged(spark, seen.where("ready").select("pos", (F.col("meets").isNull() | (F.col("weight") > F.col("meets.w2"))).alias("stays"), F.when(F.col("weight") > F.col("meets.w2"), F.col("meets.rival")).alias("out")), "done")
        out = done.where("out is not null").select(F.col("out").alias("pos")).distinct().withColumn("gone", F.lit(True))
        moved = state.join(done.select("pos", "stays"), "pos", "left").join(out, "pos", "left")
        state = staged(spark, moved.select("pos", "weight", (F.col("open") & F.col("stays").isNull()).alias("open"), (F.coalesce("stays", "kept") & F.col("gone").isNull()).alias("kept")), "settled")
    return state.where("kept").select("pos")


def merge_results(results: DataFrame, threshold: float = 0.85) -> DataFrame:
    """results (pos, doi, title, score, weight, ...): one row for each DOI and each group of similar titles, as a scan in order of pos would keep them.

    Of a DOI's rows the one with the best weighted score (the first of equals) stays, in the place of the DOI's first row; rows without a DOI come after those, in
    order, each against what stayed so far: it replaces the first similar row if it weighs more, else goes.
    """
    spark = results.sparkSession
    shared_folder(spark)
    weighted = staged(spark, results.withColumn("__w", F.col("score") * F.col("weight")), "results")
    found = F.coalesce(normalize_doi("doi"), F.lit(""))
    best = weighted.where(found != "").groupBy(found.alias("d")).agg(F.min("pos").alias("first"), F.max_by("pos", F.struct("__w", -F.col("pos"))).alias("pos"))
    # Rows with a DOI come first; both kinds keep their order.
    keyed = weighted.join(best.select("pos", "first"), "pos", "left").where((found == "") | F.col("first").isNotNull())
    seat = F.struct(F.col("first").isNull().alias("late"), F.coalesce("first", "pos").alias("at"))
    rows = staged(spark, keyed.select(seat.alias("seat"), "pos", F.trim(F.lower(F.trim("title"))).alias("t"), F.col("__w").alias("weight")), "seated")
    pairs = staged(spark, similar_titles(rows, threshold, "t"), "similar")
    return weighted.join(survivors_of(rows, pairs.select("a", "b")), "pos", "left_semi").drop("__w")


def survivors_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pos of the rows (seat, pos, t, weight) that the replay keeps; pairs: titles a that are similar to b. Groups of titles tied by pairs are replayed side by side."""
    spark = rows.sparkSession
    node = lambda c: F.xxhash64(c)
    group = staged(spark, components(pairs.select(node("a").alias("a"), node("b").alias("b"))), "groups")
    keyed = rows.where("t <> ''").withColumn("node", node("t")).join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = keyed.groupBy("component").agg(F.count("*").alias("n"))
    own = staged(spark, keyed.drop("node").join(sizes, "component"), "grouped")
    tied = pairs.withColumn("node", node("a")).join(group, "node").select("component", "a", "b")

    def run(members, near):
        import pyarrow as pa

        similar: dict = {}
        for a, b in zip(near.column("a").to_pylist(), near.column("b").to_pylist(), strict=True):
            similar.setdefault(a, []).append(b)
        seats = [(s["late"], s["at"]) for s in members.column("seat").to_pylist()]
        return pa.table({"pos": pa.array(sorted(replay(list(zip(seats, *(members.column(c).to_pylist() for c in ("pos", "t", "weight")), strict=True)), similar)), pa.int64())})

    small = own.where((F.col("n") > 1) & (F.col("n") <= REPLAY_ROWS)).select("component", "seat", F.col("pos").cast("long").alias("pos"), "t", "weight")
    replayed = small.groupBy("component").cogroup(tied.groupBy("component")).applyInArrow(run, "pos long")
    alone = rows.where("t is null or t = ''").select("pos").unionByName(own.where("n = 1").select("pos"))
    done = alone.select(F.col("pos").cast("long").alias("pos")).unionByName(replayed)
    large = own.where(F.col("n") > REPLAY_ROWS)
    if not large.isEmpty():
        met = pairs.unionByName(large.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select(F.col("t").alias("a"), F.col("t").alias("b")))
        late = large.where("seat.late").select("seat", "t").join(met, F.col("t") == F.col("a")).select("seat", "b")
        edges = late.join(large.select(F.col("seat").alias("rival"), F.col("t").alias("t2")), F.col("b") == F.col("t2")).where("rival < seat")
        edges = staged(spark, edges.select(F.col("seat").alias("pos"), "rival"), "rivals")
        left = settle_in_rounds(large.select(F.col("seat").alias("pos"), "weight"), edges)
        done = done.unionByName(large.join(left.select(F.col("pos").alias("seat")), "seat", "left_semi").select(F.col("pos").cast("long").alias("pos")))
    return done


def greedy_distinct(rows: DataFrame, group: list[str], order: list, similar, columns: list[str]) -> DataFrame:
    """In each group, in the given order, rows that `similar` no kept row. `similar(row, kept_row)` sees dicts of `columns`; groups are bounded result lists."""
    names = rows.columns

    def choose(pdf):
        kept, keep = [], []
        for i, row in enumerate(pdf[columns].to_dict("records")):
            if not any(similar(row, k) for k in kept):
                kept.append(row)
                keep.append(i)
        return pdf.iloc[keep][names]

    w = Window.partitionBy(*group).orderBy(*order)
    ordered = rows.withColumn("__n", F.row_number().over(w))
    schema = rows.schema

    def run(pdf):
        return choose(pdf.sort_values("__n"))

    return ordered.groupBy(*group).applyInPandas(run, schema)


def merge_by_doi(results: DataFrame) -> DataFrame:
    """The best weighted row of each DOI; rows without one stay."""
    weighted = F.col("score") * F.col("weight")
    key = F.coalesce("doi", F.concat(F.lit("\u0000"), F.col("source"), F.lit("/"), F.col("paper_id")))
    w = Window.partitionBy(key).orderBy(weighted.desc(), "source", "paper_id")
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def best_candidate(candidates: DataFrame, threshold: float, year: Column | str) -> DataFrame:
    """candidates (item, cand, ratio, cand_year, ...): the best of the same year if it reaches threshold - 0.1, else the best that reaches it."""
    top = candidates.groupBy("item").agg(
        F.max_by(F.struct("cand", "ratio"), F.struct("ratio", "cand")).alias("any"),
        F.max_by(F.struct("cand", "ratio"), F.when(F.col("cand_year") == col(year), F.struct("ratio", "cand"))).alias("same"),
    )
    pick = F.when(F.col("same.ratio") >= threshold - 0.1, F.col("same")).when(F.col("any.ratio") >= threshold, F.col("any"))
    return top.select("item", pick["cand"].alias("cand"), pick["ratio"].alias("ratio"))


def duplicate_groups(records: DataFrame) -> DataFrame:
    """records (item_id, item_type, title, doi, n_pdfs, n_pdf_paths, metadata_score, modified, added): source, group_key, item_id, keeper for each
    member of a group of two or more.

    Records with a DOI are grouped by it, others by their title (lower case, blanks collapsed; blank titles too); a group of titles counts only if some have a PDF
    and some have none. Attachments are left out. The keeper is no web page, has a PDF, has one PDF path, has more metadata,
    was modified, then added last; in that order of weight, the first item of equals. Groups of any size: counts, a maximum and a join.
    """
    doi = F.nullif(F.regexp_replace(F.lower(F.trim("doi")), r"^https?://(?:dx\.)?doi\.org/", ""), F.lit(""))
    title = F.regexp_replace(F.lower(F.trim(F.coalesce("title", F.lit("")))), r"\s+", " ")
    rows = records.where("item_type is distinct from 'attachment'").withColumn("source", F.when(doi.isNotNull(), "doi").otherwise("title")).withColumn("group_key", F.coalesce(doi, title))
    has = F.coalesce("n_pdfs", F.lit(0)) > 0
    worth = F.struct(F.coalesce(F.col("item_type") != "webpage", F.lit(True)).alias("a"), has.alias("b"), F.coalesce(F.col("n_pdf_paths") == 1, F.lit(False)).alias("c"), "metadata_score", "modified", "added", (-F.col("item_id")).alias("d"))
    best = rows.groupBy("source", "group_key").agg(F.max_by("item_id", worth).alias("keeper"), F.count("*").alias("n"), F.bool_or(has).alias("some"), F.bool_or(~has).alias("none"))
    kept = best.where("n > 1 and (source = 'doi' or (some and none))").select("source", "group_key", "keeper")
    return rows.select("source", "group_key", "item_id").join(kept, ["source", "group_key"])


def overlap_matches(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """left (a, ta), right (b, tb): ids with distinct title words. a, b, overlap: pairs whose shared words are at least this share of the smaller set.

    The smaller set of such a pair has one of its rarest words in the other: as many of them as it can lack, and one. Only these are joined with the other side's words.
    """
    sides = {"a": left.where("size(ta) > 0"), "b": right.where("size(tb) > 0")}
    words = {k: df.select(k, F.col(f"t{k}").alias("t"), F.size(f"t{k}").alias(f"n{k}"), F.explode(f"t{k}").alias("w")) for k, df in sides.items()}
    spread = words["a"].select("w").unionByName(words["b"].select("w")).groupBy("w").agg(F.count("*").alias("df"))

    def rare(k: str) -> DataFrame:
        n = F.col(f"n{k}")
        place = F.row_number().over(Window.partitionBy(k).orderBy("df", "w"))
        return words[k].drop("t").join(spread, "w").withColumn("p", place).where(F.col("p") <= n - F.ceil(n * threshold - 1e-9) + 1).select("w", k, f"n{k}")

    every = {k: w.select("w", k, f"n{k}") for k, w in words.items()}
    met = rare("a").join(every["b"], "w").where("na <= nb").select("a", "b").unionByName(rare("b").join(every["a"], "w").where("nb < na").select("a", "b")).distinct()
    both = met.join(sides["a"].select("a", "ta"), "a").join(sides["b"].select("b", "tb"), "b")
    return both.select("a", "b", (F.size(F.array_intersect("ta", "tb")) / F.least(F.size("ta"), F.size("tb"))).alias("overlap")).where(F.col("overlap") >= threshold)
