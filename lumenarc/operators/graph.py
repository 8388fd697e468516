"""Citation and similarity graphs, hierarchies, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.ids import find_dois, normalize_doi
from lumenarc.functions.text import normalize_title, title_tokens
from lumenarc.operators.blocks import Blocks, pairs_in_blocks
from lumenarc.sources.store import staged

CHAPTER = r"(?i)(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)"


def path_of(nodes: DataFrame, hops: int = 10, separator: str = "/") -> DataFrame:
    """nodes (id, name, parent): id, path from the root; parents are followed `hops` times at most."""
    out = nodes.select("id", F.col("name").alias("path"), F.col("parent").alias("__up"))
    up = nodes.select(F.col("id").alias("__up"), F.col("name").alias("__name"), F.col("parent").alias("__next"))
    for _ in range(hops):
        out = out.join(F.broadcast(up), "__up", "left").select("id", F.when(F.col("__name").isNotNull(), F.concat_ws(separator, "__name", "path")).otherwise(F.col("path")).alias("path"), F.col("__next").alias("__up"))
    return out.select("id", "path")


def doi_edges(texts: DataFrame, papers: DataFrame) -> DataFrame:
    """texts (paper_id, text) that name a paper's DOI: source, target, confidence 1."""
    cited = texts.select(F.col("paper_id").alias("source"), F.explode(find_dois("text")).alias("d"))
    known = papers.select(F.col("paper_id").alias("target"), normalize_doi("doi").alias("d")).where("d is not null")
    return cited.join(known, "d").where("source <> target").select("source", "target").distinct().withColumn("confidence", F.lit(1.0))


def title_index(papers: DataFrame, min_chars: int = 15, min_tokens: int = 3) -> DataFrame:
    """target, tokens of titles long enough to be matched."""
    return papers.where(F.length("title") >= min_chars).select(F.col("paper_id").alias("target"), title_tokens("title").alias("tokens")).where(F.size("tokens") >= min_tokens)


def title_edges(texts: DataFrame, index: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Texts that hold a title's tokens: token equi-join and count in place of a nested loop.

    Only a title's rarest tokens need to meet: with n tokens and threshold t, a match holds one of any
    n - ceil(t n) + 1 tokens. Those of the smallest document frequency find the candidates, and the
    full token sets decide.
    """
    each = index.select("target", F.size("tokens").alias("n"), F.explode("tokens").alias("w"))
    # Texts are cut into words once; only words of titles stay.
    cut = texts.select(F.col("paper_id").alias("source"), F.explode(title_tokens("text")).alias("w"))
    held = staged(texts.sparkSession, cut.join(each.select("w").distinct(), "w", "left_semi").select("source", "w"), "title-words")
    words = held.groupBy("source").agg(F.collect_set("w").alias("all"))  # distinct words of titles in a text
    rare = held.groupBy("w").agg(F.count("*").alias("df"))
    order = Window.partitionBy("target").orderBy(F.coalesce("df", F.lit(0)), "w")
    probe = each.join(rare, "w", "left").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    pairs = held.join(probe.select("w", "target"), "w").where("source <> target").select("source", "target").distinct()
    full = pairs.join(index, "target").join(words, "source")
    common = F.size(F.array_intersect("tokens", "all"))
    share = common / F.size("tokens")
    ok = full.where((common >= F.least(F.lit(3), F.size("tokens"))) & (share >= threshold))
    return ok.select("source", "target", F.when(share > 0.9, 0.9).otherwise(0.7).alias("confidence"))


def reference_edges(references: DataFrame, papers: DataFrame, threshold: float = 0.85) -> DataFrame:
    """references (paper_id, ref_pos, title, doi): by DOI, else the first paper (pos) whose title's Jaccard similarity reaches the threshold."""
    known = papers.select(F.col("paper_id").alias("target"), normalize_doi("doi").alias("d")).where("d is not null")
    refs = references.withColumn("d", normalize_doi("doi"))
    by_doi = refs.join(known, "d").select(F.col("paper_id").alias("source"), "ref_pos", "target", F.lit(1.0).alias("confidence")).distinct()
    rest = refs.join(known.select("d"), "d", "left_anti").select("paper_id", "ref_pos", F.array_sort(title_tokens("title")).alias("r")).where("size(r) > 0").distinct()
    # Of papers of one title only the first can be the target; equal titles are asked once, by as many of their rarest tokens as a match cannot lack.
    index = papers.select(F.struct("pos", F.col("paper_id").alias("target")).alias("hit"), title_tokens("title").alias("t")).where("size(t) > 0").groupBy("t").agg(F.min("hit").alias("hit"))
    tokens = index.select("hit", "t", F.explode("t").alias("w"))
    each = rest.select("r").distinct().select("r", F.explode("r").alias("w")).join(tokens.groupBy("w").agg(F.count("*").alias("df")), "w", "left")
    place = F.row_number().over(Window.partitionBy("r").orderBy(F.coalesce("df", F.lit(0)), "w"))
    probe = each.withColumn("__n", place).where(F.col("__n") <= F.size("r") - F.ceil(F.size("r") * threshold) + 1)
    near = probe.join(tokens, "w").where((F.size("r") >= threshold * F.size("t")) & (F.size("t") >= threshold * F.size("r"))).select("r", "hit", "t").distinct()
    both = F.size(F.array_intersect("r", "t"))
    first = near.where(both / (F.size("r") + F.size("t") - both) >= threshold).groupBy("r").agg(F.min("hit").alias("hit"))
    first = first.join(rest, "r").groupBy("paper_id", "ref_pos").agg(F.min("hit")["target"].alias("target"))
    by_title = first.select(F.col("paper_id").alias("source"), "ref_pos", "target", F.lit(0.95).alias("confidence"))
    return by_doi.unionByName(by_title).where("source <> target")


#: Tasks that share the pairs of a key.
DEAL = 16


def part_of(papers: DataFrame) -> DataFrame:
    """child, parent, kind, by three rules; a child of one rule is not asked by the next.

    Book sections belong to the books that share their library_key. Titles that three papers or more
    share, with two different theses at least, make a virtual collection. A title "chapter N" belongs to the
    first paper of the same authors and first three title words that is no chapter. Columns library_key,
    item_type and thesis may be missing.
    """
    names = papers.columns
    p = papers.where("paper_id is not null").withColumn("__n", normalize_title(F.coalesce("title", F.lit(""))))
    found = []
    if {"library_key", "item_type"} <= set(names):
        keyed = p.where("coalesce(library_key, '') <> ''")
        books = keyed.where("item_type = 'book'").select("library_key", F.col("paper_id").alias("parent"))
        parts = keyed.where("item_type = 'bookSection'").select("library_key", F.col("paper_id").alias("child"))
        # A key may have many parts and books, and each pair of them is a row: a key's parts are dealt to DEAL tasks, with its books in each.
        tasks = 8 * papers.sparkSession.sparkContext.defaultParallelism
        parts = parts.withColumn("__s", F.pmod(F.xxhash64("child"), F.lit(DEAL))).repartition(tasks, "library_key", "__s")
        books = books.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long")))).repartition(tasks, "library_key", "__s")
        found.append(parts.join(books, ["library_key", "__s"]).where("child <> parent").select("child", "parent", F.lit("chapter_in_book").alias("kind")))
        sections = keyed.where("item_type = 'bookSection'").join(keyed.where("item_type = 'book'").groupBy("library_key").agg(F.min("paper_id").alias("__lo"), F.max("paper_id").alias("__hi")), "library_key")
        # A section has a book if one of its key's books is not the section itself.
        p = p.join(sections.where("__lo <> paper_id or __hi <> paper_id").select("paper_id").distinct(), "paper_id", "left_anti")
    if "thesis" in names:
        named = papers.withColumn("__n", normalize_title(F.coalesce("title", F.lit("")))).where("__n not in ('', 'untitled')")
        thesis = F.nullif(F.trim("thesis"), F.lit(""))
        shared = named.groupBy("__n").agg(F.count("*").alias("__c"), F.count_distinct(thesis).alias("__t")).where("__c >= 3 and __t >= 2").select("__n")
        parent = F.concat(F.lit("virtual_collection_"), F.replace(F.substring("__n", 1, 40), F.lit(" "), F.lit("_")))
        readings = p.join(shared, "__n").select(F.col("paper_id").alias("child"), parent.alias("parent"), F.lit("reading_in_syllabus").alias("kind")).distinct()
        found.append(readings)
        p = p.join(shared, "__n", "left_anti")
    start = F.slice(F.split("__n", " "), 1, 3)
    chapter = F.coalesce(F.col("title").rlike(CHAPTER), F.lit(False))
    tagged = p.withColumn("__a", normalize_title(F.coalesce("author_string", F.lit("")))).withColumn("__p", start).where("__a <> '' and size(__p) = 3")
    wholes = papers.withColumn("__n", normalize_title(F.coalesce("title", F.lit("")))).where(~chapter).withColumn("__a", normalize_title(F.coalesce("author_string", F.lit("")))).withColumn("__p", start)
    firsts = wholes.where("size(__p) = 3 and paper_id is not null").groupBy("__a", "__p").agg(F.min_by("paper_id", "pos").alias("parent"))
    found.append(tagged.where(chapter).join(firsts, ["__a", "__p"]).select(F.col("paper_id").alias("child"), "parent", F.lit("chapter_in_book").alias("kind")))
    return reduce(lambda a, b: a.unionByName(b), found)


def first_edges(*ranked: DataFrame) -> DataFrame:
    """Edges of several strategies; of each pair that of the first strategy."""
    tagged = [e.select("source", "target", "confidence").withColumn("rank", F.lit(i)) for i, e in enumerate(ranked)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    return both.groupBy("source", "target").agg(F.min_by("confidence", "rank").alias("confidence"), F.min("rank").alias("rank"))


def sized_nodes(nodes: DataFrame, edges: DataFrame, key: str = "paper_id") -> DataFrame:
    deg = edges.groupBy(F.col("target").alias(key)).agg(F.count("*").alias("__d"))
    out = nodes.join(deg, key, "left").withColumn("in_degree", F.coalesce("__d", F.lit(0))).drop("__d")
    return out.withColumn("size", 10 + 5 * F.col("in_degree")).withColumn("hub", F.col("in_degree") >= 5)


#: Open edges from which the rest of a greedy scan is replayed in one task.
REPLAY_EDGES = 100_000


def capped_edges(pairs: DataFrame, cap: int, before: DataFrame | None = None) -> DataFrame:
    """The edges a greedy scan by (score desc, source, target) accepts while both ends have fewer than `cap`. before (source, target): accepted earlier.

    In rounds: an open edge is accepted when it is among the first (cap - accepted) open edges of both
    its ends, and dropped when an end is full. This gives the scan's edges without one sequential task.
    """
    order = [F.col("score").desc(), "source", "target"]
    open_, taken = pairs.select("source", "target", "score"), None
    while True:
        ends = open_.select("*", F.explode(F.array("source", "target")).alias("node"))
        held = [df.select("source", "target") for df in (before, taken) if df is not None]
        if held:
            used = reduce(lambda a, b: a.unionByName(b), held).select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
            left = ends.join(used, "node", "left")
        else:
            left = ends.withColumn("used", F.lit(0))
        room = cap - F.coalesce("used", F.lit(0))
        place = left.withColumn("__n", F.row_number().over(Window.partitionBy("node").orderBy(*order)))
        state = place.groupBy("source", "target", "score").agg(F.bool_and(F.col("__n") <= room).alias("ok"), F.bool_or(room <= 0).alias("full")).checkpoint()
        good = state.where("ok").select("source", "target", "score")
        taken = good if taken is None else taken.unionByName(good)
        open_ = state.where("not ok and not full").select("source", "target", "score")
        left = open_.limit(REPLAY_EDGES + 1).count()
        if not left:
            break
        if left <= REPLAY_EDGES:
            return taken.unionByName(scanned(open_, [df.select("source", "target") for df in (before, taken) if df is not None], cap))
    return taken


def scanned(edges: DataFrame, held: list[DataFrame], cap: int) -> DataFrame:
    """What the scan accepts of at most REPLAY_EDGES edges, after those in held, in one task."""
    used = reduce(lambda a, b: a.unionByName(b), held).select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
    for end in ("source", "target"):
        edges = edges.join(used.select(F.col("node").alias(end), F.col("used").alias(f"{end}_used")), end, "left")

    def scan(table):
        import pyarrow as pa

        rows, count, keep = table.to_pylist(), {}, []
        for r in rows:
            for end in ("source", "target"):
                count[r[end]] = r[f"{end}_used"] or 0
        for i in sorted(range(len(rows)), key=lambda i: (-rows[i]["score"], rows[i]["source"], rows[i]["target"])):
            one, two = rows[i]["source"], rows[i]["target"]
            if count[one] < cap and count[two] < cap:
                count[one] += 1
                count[two] += 1
                keep.append(i)
        return table.select(["source", "target", "score"]).take(pa.array(keep, pa.int64()))

    schema = ", ".join(f"{c} {t}" for c, t in edges.select("source", "target", "score").dtypes)
    return edges.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(scan, schema)


#: Vectors of the sample that sets where a tier of scores ends, and edges to a vector that a tier should have for each edge it may keep.
TIER_SAMPLE, TIER_EDGES = 2048, 8


def capped_similarity_graph(vectors: DataFrame, key: str, cap: int, least: float, digits: int = 9) -> DataFrame:
    """source, target, score: what `capped_edges` accepts of all pairs of vectors (source < target) whose rounded cosine is at least `least`.

    Scores are gone through in tiers from the highest down. The scan never looks at lower edges of a vector that is full, so each tier is compared only
    among vectors with room, and its edges stay in proportion to them. Where a tier ends comes from a sample; the result does not depend on it.
    """
    import numpy as np

    from lumenarc.sources.store import staged

    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col("embedding").alias("v")).where("v is not null")
    taken, below, n = None, float("inf"), rows.count()
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < -(-2 * TIER_SAMPLE * (1 << 30) // max(n, 1))).orderBy(F.xxhash64("id")).limit(TIER_SAMPLE)
    x, scores = np.array([r["v"] for r in some.select("v").collect()], float), np.zeros(0)
    if len(x) > 1:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        scores = np.sort((x @ x.T)[np.triu_indices(len(x), 1)])[::-1]
        scores = scores[scores >= least]
    open_ = rows
    while n > 1:
        here = scores[scores < below]
        most = int(TIER_EDGES * cap * len(x) * (len(x) - 1) / (n - 1))  # the sample's share of the tier's edges
        floor = round(max(float(here[most]), least), digits) if 0 < most < len(here) else least
        floor = floor if floor < below else least
        pairs = pairs_in_blocks(Blocks(open_), floor, digits, True, below)
        good = capped_edges(pairs.select(F.col("src").alias("source"), F.col("dst").alias("target"), "score"), cap, taken)
        taken = staged(spark, good if taken is None else taken.unionByName(good), "accepted")
        if floor <= least:
            return taken
        full = taken.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") >= cap)
        open_, below = staged(spark, rows.join(full, "id", "left_anti"), "open"), floor
        n = open_.count()
    return taken if taken is not None else spark.createDataFrame([], f"source {dict(rows.dtypes)['id']}, target {dict(rows.dtypes)['id']}, score double")


#: Edges of a node from which its rows stay where they are as its smallest neighbour is joined to them.
HUB_EDGES = 1 << 14


def with_least(edges: DataFrame, both: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with m, the least of u's neighbours in `both`, and a row for each u. Nodes of many edges (fewer than edges / HUB_EDGES) are broadcast, so that no task gets all edges of one."""
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", least.alias("m"), "n").checkpoint()
    hubs, plain = (F.broadcast(low.where(F.col("n") > HUB_EDGES).select("u", "m")), low.where(F.col("n") <= HUB_EDGES).select("u", "m"))
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(plain, "u")), low


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node): alternating star contraction with checkpoints."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = with_least(both.where("v > u"), both, F.least("u", "m"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        small, low = with_least(large, large, F.col("m"))
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def density_clusters(pairs: DataFrame, nodes: DataFrame, min_size: int = 5) -> DataFrame:
    """pairs (a, b) of neighbours, nodes (node): label (smallest member) of groups of min_size or more, else -1."""
    comp = components(pairs)
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    big = comp.join(size.where(F.col("n") >= min_size), "component").select("node", F.col("component").alias("label"))
    return nodes.join(big, "node", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def principal_components(vectors: DataFrame, key: str, vector_col: str, k: int) -> DataFrame:
    """key, p: the first k principal components, from Spark ML."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows).select(key, vector_to_array("p").alias("p"))


def project_2d(vectors: DataFrame, key: str) -> DataFrame:
    """key, x, y: the first two principal components."""
    done = principal_components(vectors, key, "embedding", 2)
    return done.select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def ego_network(pairs: DataFrame, centre) -> DataFrame:
    """Edges from one node with sizes by score."""
    hit = pairs.where(F.col("src") == F.lit(centre))
    return hit.select("src", "dst", "score", (15 + F.floor(15 * F.col("score"))).cast("int").alias("size"))


