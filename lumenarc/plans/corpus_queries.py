"""Filters, joins, aggregates, windows and set operations over the corpus (FLT, JOIN, AGG, WIN, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarc.functions.ids import normalize_doi
from lumenarc.functions.text import jaccard, title_tokens, topic_tokens, word_count
from lumenarc.operators import corpus as C
from lumenarc.operators import views as V
from lumenarc.plans.inputs import ANSWERS, PAPERS, answers, papers, sql_title_tokens, sql_topic_tokens, sql_words, table

NORM_DOI = "regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|(dx\\.)?doi\\.org/|doi:)\\s*', '')"


def flt_01(spark, sf):
    out = C.search_metadata(papers(spark, sf), title="the", year_min=2000, year_max=2015, collection="src3", item_type="en")
    return out.select("paper_id", "title", "year")


def flt_02(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("event_type").isin("click", "purchase", "view") & (F.col("value") >= 50) & (F.col("user_id") <= 100)).select("event_id", "event_type", "value")


def flt_04(spark, sf):
    return C.filter_papers(papers(spark, sf), collections=["src1", "lang/de"], year_min=1995, year_max=2010).select("paper_id", "year")


def flt_06(spark, sf):
    return C.filter_papers(papers(spark, sf), collections=["lang/fr", "src2"]).select("paper_id", "collection")


def flt_07(spark, sf):
    p = papers(spark, sf).where(F.exists("collections", lambda c: F.contains(c, F.lit("src1"))))
    return p.select("paper_id", (word_count("text") >= 100).alias("extractable"))


def doi_split(kind):
    def run(spark, sf):
        p = papers(spark, sf).withColumn("d", normalize_doi("doi"))
        known = table(spark, sf, "supplier").select(F.concat(F.lit("10.1000/x"), "s_suppkey").alias("d"))
        return p.join(known, "d", "left_semi" if kind == "known" else "left_anti").select("paper_id", "d")

    return run


def flt_09(spark, sf):
    p = papers(spark, sf)
    ok = C.is_extractable(F.when(F.col("item_type") == "es", "non_academic").otherwise("research_paper"), word_count("text"), F.lit(None).cast("int"))
    return p.groupBy("item_type").agg(F.count_if(ok).alias("extractable"), F.count_if(~ok).alias("skipped"))


def flt_11(spark, sf):
    return V.missing_from(papers(spark, sf), answers(spark, sf), "paper_id")


def flt_12(spark, sf):
    p = C.filter_papers(papers(spark, sf), collections=["src1", "src2", "src3"]).where(F.col("item_type").isin("en", "de"))
    return p.orderBy("pos").limit(20).select("paper_id", F.lit(1.0).alias("score"))


def flt_14(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.least(F.greatest("p_size", F.lit(1)), F.lit(25)).alias("top_k"), F.length("p_name").between(1, 1000).alias("valid_query"))


def flt_16(spark, sf):
    o = table(spark, sf, "orders")
    return V.pending_ids(o, "o_orderkey", o.where("o_orderstatus = 'F'"), o.where("o_orderkey % 11 = 0"), 100)


def flt_17(spark, sf):
    return V.split_parents(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


def flt_18(spark, sf):
    p = papers(spark, sf).withColumn("w", word_count("text"))
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("w") < 500, F.concat(F.lit("word_count<500:"), "w")), F.when(F.size(F.split("text", "\n")) < 2, F.lit("line_count<2")))), ";")
    return p.select("paper_id", (F.col("w") >= 100).alias("valid"), reasons.alias("reasons"))


def flt_19(spark, sf):
    return V.missing_from(answers(spark, sf), papers(spark, sf), "paper_id")


def flt_22(spark, sf):
    cov = C.coverage(answers(spark, sf), 10, ["q01", "q02"])
    p = papers(spark, sf).where(F.col("item_type").isin("en", "fr")).select("paper_id", "title")
    return cov.where("coverage < 0.5").join(p, "paper_id").where(~F.col("title").rlike("(?i)^the ")).orderBy("answered", "paper_id").limit(30).select("paper_id", "answered")


def join_01(spark, sf):
    from lumenarc.operators.search import enrich

    hits = table(spark, sf, "labels").select(F.concat(F.lit("p"), "doc_id").alias("paper_id"), "quality")
    ext = answers(spark, sf).groupBy("paper_id").agg(F.count("value").alias("dims"))
    return enrich(hits, papers(spark, sf).select("paper_id", "title", "year"), ext)


def join_03(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("pos"))
    p = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("dst"), "p_name")
    return V.enrich_pairs(li, p, "dst").select("src", "pos", "dst", "p_name")


def join_04(spark, sf):
    o = table(spark, sf, "orders")
    before = o.where("o_orderkey % 10 <> 0").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("mark"))
    after = o.where("o_orderkey % 10 <> 1").select("o_orderkey", F.sha2(F.concat_ws("|", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority"), 256).alias("mark"))
    return C.snapshot_diff(before, after, "o_orderkey", "mark", o.where("o_orderkey % 50 = 3").select("o_orderkey"))


def join_05(spark, sf):
    o = table(spark, sf, "orders")
    seen = o.where("o_orderkey % 9 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("held"))
    now = o.where("o_orderkey % 8 <> 0").select("o_orderkey", "o_orderdate")
    return V.date_changes(seen, now, "o_orderkey", "held", "o_orderdate").groupBy("change").agg(F.count("*").alias("n"))


def join_07(spark, sf):
    """Pairs of first lines of documents and benchmark items with a Jaccard similarity over 0.85: token join with a length filter."""
    a = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", title_tokens("line").alias("t")).where("size(t) >= 3").distinct()
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", title_tokens("line").alias("u")).where("size(u) >= 3").distinct()
    ea = a.select("doc_id", "t", F.xxhash64("t").alias("h"), F.explode("t").alias("w"))
    eb = b.select("item_id", F.size("u").alias("nu"), F.xxhash64("u").alias("g"), F.explode("u").alias("w"))
    common = ea.join(F.broadcast(eb), "w").where((F.size("t") >= 0.85 * F.col("nu")) & (F.col("nu") >= 0.85 * F.size("t")))
    hit = common.groupBy("doc_id", "h", "item_id", "g", "nu", F.size("t").alias("nt")).agg(F.count("*").alias("k")).where("k / (nt + nu - k) >= 0.85")
    return hit.groupBy("doc_id", "item_id").agg(F.round(F.max(F.col("k") / (F.col("nt") + F.col("nu") - F.col("k"))), 6).alias("similarity"))


def join_08(spark, sf):
    """Benchmark items found in documents: containment of their tokens, by an exploded token join."""
    items = table(spark, sf, "benchmark").select("item_id", title_tokens("text").alias("t"))
    each = items.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    docs = table(spark, sf, "documents").select("doc_id", F.explode(title_tokens("text")).alias("w"))
    hit = docs.join(F.broadcast(each), "w").groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("k")).where("k >= least(3, n) and k / n >= 0.85")
    return hit.select("doc_id", "item_id", F.when(F.col("k") / F.col("n") > 0.9, 0.9).otherwise(0.7).alias("confidence"))


def join_10(spark, sf):
    d = C.directions(table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("pos"), F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.split("text", "\n")[0].alias("t")), "t")
    index = C.token_lists(papers(spark, sf).where("item_type = 'en'"), "text")
    out = C.direction_coverage(d.where("size(tokens) >= 2"), index)
    return out.select("norm", "mentions", F.array_join("tokens", " ").alias("tokens"), "covered")


def join_11(spark, sf):
    p = papers(spark, sf).select(normalize_doi("doi").alias("d"))
    known = table(spark, sf, "supplier").select(F.concat(F.lit("10.1000/x"), "s_suppkey").alias("d"), F.lit(True).alias("hit"))
    return p.join(known, "d", "left").agg(F.count("*").alias("total"), F.count_if(F.col("d").isNull()).alias("without"), F.count_if(F.col("hit")).alias("overlap"), F.count_if(F.col("d").isNotNull() & F.col("hit").isNull()).alias("fresh"))


def join_12(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return V.widest_pairs(c, s, "nation", "c_acctbal", "s_acctbal", ["c_custkey", "s_suppkey"], 40).join(n, "nation").select("c_custkey", "s_suppkey", "n_name", "score")


def join_13(spark, sf):
    key = F.col("o_orderkey")
    reason = V.first_reason(new=key % 10 == 0, modified=F.col("o_orderstatus") == "P", forced=F.col("o_orderpriority").startswith("1"), pending=key % 13 == 0)
    return table(spark, sf, "orders").select("o_orderkey", reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def join_14(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return V.related_counts(table(spark, sf, "orders").select("o_orderkey"), li, "o_orderkey", returned=F.col("l_returnflag") == "R", lines=F.lit(True))


def join_15(spark, sf):
    from lumenarc.functions.text import containment

    p = papers(spark, sf).withColumn("t", title_tokens("title")).withColumn("x", title_tokens(F.substring("text", 1, 1000)))
    share = containment("t", "x")
    return p.select("paper_id", F.when(F.size("t") < 3, True).otherwise(share >= 0.3).alias("matches"), F.round(share, 6).alias("share"))


def join_16(spark, sf):
    cust = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return V.kept_by(table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), cust, "o_custkey").select("o_orderkey", "o_custkey")


def agg_01(spark, sf):
    p = papers(spark, sf)
    part = lambda name, df: df.select(F.lit(name).alias("section"), "key", "n")
    types = part("type", C.count_by(p, "item_type"))
    years = part("year", C.count_by(p.where("year is not null"), "year"))
    colls = part("collection", C.count_by(p.select(F.explode("collections").alias("c")), "c", top=20))
    return types.unionByName(years).unionByName(colls)


def agg_01_total(spark, sf):
    p = papers(spark, sf)
    return p.agg(F.count("*").alias("papers"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(word_count("text")).cast("long").alias("words"), F.count("year").alias("dated"))


def agg_02(spark, sf):
    kinds = spark.range(10).select(F.col("id").cast("int").alias("label"))
    return V.counts_of_kinds(table(spark, sf, "embeddings").where("label <> 3"), kinds, "label")


def agg_03(spark, sf):
    return V.corpus_range(papers(spark, sf))


def agg_04(spark, sf):
    o = table(spark, sf, "orders").withColumn("open", F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no"))
    return V.counts_by_each(o, status="o_orderstatus", priority="o_orderpriority", open="open")


def agg_05(spark, sf):
    return V.confidence_bands(table(spark, sf, "events"), "event_type", F.col("value") / 100)


def agg_06(spark, sf):
    return V.group_heads(table(spark, sf, "part"), "p_brand", "p_partkey").withColumnRenamed("__g", "p_brand")


def agg_07(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("p"), "p_partkey").alias("paper_id"), F.regexp_replace("p_type", " ", ", ").alias("field"))
    return C.topic_counts(rows, "field")


def agg_08(spark, sf):
    return C.count_by(papers(spark, sf).where("year is not null"), "year").select(F.col("key").cast("int").alias("year"), "n")


def agg_09(spark, sf):
    return C.nearest_rank(table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n", 0.2)


def agg_10(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat(F.lit("p"), "conv_id").alias("paper_id"), "text")
    return C.directions(rows, "text").select("norm", "direction", "mentions", F.array_join("tokens", " ").alias("tokens"))


def agg_11(spark, sf):
    idx = C.token_index(papers(spark, sf).where("item_type in ('en', 'de')"), "title")
    return idx.groupBy("token").agg(F.count("*").alias("papers")).where("papers >= 2")


def agg_12(spark, sf):
    return C.coverage(answers(spark, sf), 10, ["q01", "q02", "q03"]).select("paper_id", "answered", F.round("coverage", 4).alias("coverage"), "tier", "missing_core")


def agg_13(spark, sf):
    c = C.coverage(answers(spark, sf), 10, ["q01", "q02", "q03"])
    tiers = spark.createDataFrame([("full",), ("partial",), ("sparse",), ("minimal",)], "tier string")
    n = c.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("coverage"), 4).alias("avg_coverage"), F.count_if(F.col("missing_core") != "").alias("core_gaps"))
    return tiers.join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"), "avg_coverage", F.coalesce("core_gaps", F.lit(0)).alias("core_gaps"))


def agg_14(spark, sf):
    return V.centroids(table(spark, sf, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


def agg_15(spark, sf):
    p = papers(spark, sf).select("collection", F.explode(F.array_distinct(topic_tokens("title"))).alias("w"))
    return p.groupBy("collection").agg(F.count_distinct("w").alias("tokens"))


def agg_16(spark, sf):
    return V.field_rates(answers(spark, sf)).withColumn("rate", F.round("rate", 6))


def agg_17(spark, sf):
    from lumenarc.operators.graph import sized_nodes

    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"))
    return sized_nodes(table(spark, sf, "part").select("p_partkey"), edges, "p_partkey").select("p_partkey", "in_degree", "size", "hub")


def agg_21(spark, sf):
    out = V.run_statistics(table(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "o_totalprice")
    return out.withColumns({"rate": F.round("rate", 6), "cost": F.round("cost", 2)})


def agg_22(spark, sf):
    cluster = F.when(F.col("label") == 9, -1).otherwise(F.col("label"))
    return V.group_heads(table(spark, sf, "embeddings"), cluster, "vec_id", size="size", heads="first").withColumnRenamed("__g", "cluster")


def agg_25(spark, sf):
    a = answers(spark, sf)
    u = a.where("provider = 'user'").select("conv_id", "dimension", F.col("value").alias("a"))
    b = a.where("provider = 'assistant'").select("conv_id", F.concat(F.lit("q"), F.lpad(F.col("turn").cast("string"), 2, "0")).alias("dimension"), F.col("value").alias("b"))
    return V.compare_answers(u, b, ["conv_id", "dimension"])


def agg_26(spark, sf):
    out = V.batch_summary(table(spark, sf, "lineitem").where("l_linestatus = 'F'"), "l_returnflag", "l_discount", "l_quantity")
    return out.withColumns({"confidence": F.round("confidence", 6), "seconds": F.round("seconds", 6)})


def agg_27(spark, sf):
    p = papers(spark, sf)
    return p.agg(F.count("*").alias("papers"), F.count_if(normalize_doi("doi").isNotNull()).alias("with_doi"))


DAYS = "(SELECT DISTINCT datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)"


def order_days(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("day")).distinct()


def win_03(spark, sf):
    return C.missing_values(order_days(spark, sf), "day")


def win_04(spark, sf):
    return C.islands(order_days(spark, sf), "day").select("start", "end", "length")


def ml_14(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("p"), "p_partkey").alias("paper_id"), F.regexp_replace("p_name", " ", ", ").alias("field"))
    n = rows.count()
    out = C.underrepresented(C.topic_counts(rows, "field"), F.lit(float(n)), most=50)
    return out.select("label", "n", "evidence", "threshold", "confidence")


def set_01(spark, sf):
    o = table(spark, sf, "orders")
    return V.first_source("o_orderkey", o.where("o_orderkey % 10 = 0"), o.where("o_orderkey % 6 = 0"), o.where("o_orderstatus = 'P'"))


def set_03(kind):
    def run(spark, sf):
        a, b = papers(spark, sf).select("paper_id"), answers(spark, sf).select("paper_id")
        return V.key_set(a, b, kind)

    return run


def set_04(spark, sf):
    p = table(spark, sf, "part")
    dim = lambda q, e: [F.concat(F.lit("d"), "p_partkey").alias("dimension"), F.col("p_brand").alias("section"), q.alias("question"), e.alias("enabled")]
    old = p.where("p_partkey % 9 <> 0").select(*dim(F.col("p_name"), F.lit(True)))
    new = p.where("p_partkey % 11 <> 0").select(*dim(F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.col("p_partkey") % 13 != 0))
    return C.profile_diff(old, new)


def set_05(spark, sf):
    return V.merge_proposals(table(spark, sf, "lineitem"), "l_partkey", "l_discount", F.col("l_quantity"), "l_orderkey", "l_suppkey")


def set_06(spark, sf):
    a = answers(spark, sf).where("value is not null")
    old, new = a.where("turn < 4").select("paper_id", "dimension", F.length("value").alias("v")), a.where("turn >= 2").select("paper_id", "dimension", (F.length("value") * 2).alias("v"))
    return C.upsert(old, new, ["paper_id", "dimension"])


def set_07(spark, sf):
    name = lambda t, c: table(spark, sf, t).select(F.col(c).alias("name"))
    return V.tagged_union(primary=name("customer", "c_name"), other=name("supplier", "s_name"))


def set_08(spark, sf):
    return V.merged_lists(papers(spark, sf), "title", "collections")


def set_09(spark, sf):
    key = lambda t, c: table(spark, sf, t).select(F.col(c).alias("key"))
    return V.key_set(key("customer", "c_nationkey"), key("supplier", "s_nationkey"), "or")


def str_06(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", title_tokens("text").alias("t"))
    pairs = b.alias("a").join(b.alias("b"), F.col("a.item_id") + 1 == F.col("b.item_id"))
    return pairs.select(F.col("a.item_id").alias("i"), F.col("b.item_id").alias("j"), F.round(jaccard("a.t", "b.t"), 6).alias("similarity"))


T = sql_title_tokens
WC = f"len({sql_words('text')})"
COVER = "c AS (SELECT paper_id, count(*) FILTER (value IS NOT NULL AND value <> '') AS answered, bool_or(coalesce(dimension = 'q01' AND value IS NOT NULL AND value <> '', false)) AS c1, bool_or(coalesce(dimension = 'q02' AND value IS NOT NULL AND value <> '', false)) AS c2, bool_or(coalesce(dimension = 'q03' AND value IS NOT NULL AND value <> '', false)) AS c3 FROM answers GROUP BY 1), cov AS (SELECT paper_id, answered, answered / 10 AS coverage, CASE WHEN answered / 10 >= 0.85 THEN 'full' WHEN answered / 10 >= 0.6 THEN 'partial' WHEN answered / 10 >= 0.3 THEN 'sparse' ELSE 'minimal' END AS tier, array_to_string(list_filter([CASE WHEN NOT c1 THEN 'q01' END, CASE WHEN NOT c2 THEN 'q02' END, CASE WHEN NOT c3 THEN 'q03' END], lambda x: x IS NOT NULL), ',') AS missing_core FROM c)"
TOPIC = "e AS (SELECT p_partkey AS pos, 'p' || p_partkey AS paper_id, lower(trim(regexp_replace(unnest(string_split(replace({0}, ' ', ', '), ',')), '\\s+', ' ', 'g'))) AS label FROM part), f AS (SELECT label, paper_id, min(pos) AS pos, count(*) AS n FROM e WHERE label <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos, paper_id) AS k FROM f), t AS (SELECT label, CAST(sum(n) AS BIGINT) AS n, string_agg(paper_id, ',' ORDER BY k) FILTER (k <= 3) AS evidence FROM r GROUP BY 1)"
DIRECTIONS = "s AS (SELECT pos, paper_id, regexp_split_to_array(t, '\\.\\s+') AS a FROM src), x AS (SELECT pos, paper_id, unnest(a) AS part, unnest(range(len(a))) AS i FROM s), y AS (SELECT *, trim(part) AS p2 FROM x WHERE trim(part) <> ''), g AS (SELECT lower(trim(regexp_replace(p2, '\\s+', ' ', 'g'))) AS norm, arg_min(p2, pos * 100000 + i) AS direction, count(DISTINCT paper_id) AS mentions FROM y GROUP BY 1), d AS (SELECT *, " + sql_topic_tokens("direction") + "[1:4] AS tokens FROM g)"

QUERIES = {
    "flt_01_metadata_search": (flt_01, f"WITH {PAPERS} SELECT paper_id, title, year FROM papers WHERE contains(lower(title), 'the') AND (year IS NULL OR year BETWEEN 2000 AND 2015) AND collection = 'src3' AND item_type = 'en'"),
    "flt_02_prefilter": (flt_02, "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase', 'view') AND value >= 50 AND user_id <= 100"),
    "flt_04_filter_papers": (flt_04, f"WITH {PAPERS} SELECT paper_id, year FROM papers WHERE (collection = 'src1' OR item_type = 'de') AND year BETWEEN 1995 AND 2010"),
    "flt_05_06_collections_any": (flt_06, f"WITH {PAPERS} SELECT paper_id, collection FROM papers WHERE collection = 'src2' OR item_type = 'fr'"),
    "flt_07_source_papers": (flt_07, f"WITH {PAPERS} SELECT paper_id, {WC} >= 100 AS extractable FROM papers WHERE contains(collection, 'src1') OR contains('lang/' || item_type, 'src1')"),
    "flt_08_doi_known": (doi_split("known"), f"WITH {PAPERS}, p AS (SELECT paper_id, {NORM_DOI} AS d FROM papers) SELECT paper_id, d FROM p WHERE d IN (SELECT '10.1000/x' || s_suppkey FROM supplier)"),
    "flt_08_doi_new": (doi_split("new"), f"WITH {PAPERS}, p AS (SELECT paper_id, {NORM_DOI} AS d FROM papers) SELECT paper_id, d FROM p WHERE d IS NULL OR d NOT IN (SELECT '10.1000/x' || s_suppkey FROM supplier)"),
    "flt_09_extractable": (flt_09, f"WITH {PAPERS}, x AS (SELECT item_type, item_type <> 'es' AND {WC} >= 500 AS ok FROM papers) SELECT item_type, count(*) FILTER (ok) AS extractable, count(*) FILTER (NOT ok) AS skipped FROM x GROUP BY 1"),
    "flt_10_11_missing_extractions": (flt_11, f"WITH {PAPERS}, {ANSWERS} SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM answers)"),
    "flt_12_execute_metadata_search": (flt_12, f"WITH {PAPERS} SELECT paper_id, CAST(1.0 AS DOUBLE) AS score FROM papers WHERE collection IN ('src1', 'src2', 'src3') AND item_type IN ('en', 'de') ORDER BY pos LIMIT 20"),
    "flt_14_validators": (flt_14, "SELECT p_partkey, least(greatest(p_size, 1), 25) AS top_k, length(p_name) BETWEEN 1 AND 1000 AS valid_query FROM part"),
    "flt_16_pending_ids": (flt_16, "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 11 <> 0 ORDER BY o_orderkey LIMIT 100"),
    "flt_17_split_parents": (flt_17, "SELECT l_orderkey, count(DISTINCT l_suppkey) AS paths FROM lineitem GROUP BY 1 HAVING paths > 1"),
    "flt_18_publication_gate": (flt_18, f"WITH {PAPERS}, x AS (SELECT paper_id, {WC} AS w, len(string_split(text, chr(10))) AS l FROM papers) SELECT paper_id, w >= 100 AS valid, concat_ws(';', CASE WHEN w < 500 THEN 'word_count<500:' || w END, CASE WHEN l < 2 THEN 'line_count<2' END) AS reasons FROM x"),
    "flt_19_store_consistency": (flt_19, f"WITH {PAPERS}, {ANSWERS} SELECT DISTINCT paper_id FROM answers WHERE paper_id NOT IN (SELECT paper_id FROM papers)"),
    "flt_22_gap_fill_candidates": (flt_22, f"WITH {PAPERS}, {ANSWERS}, {COVER} SELECT paper_id, answered FROM cov JOIN papers USING (paper_id) WHERE coverage < 0.5 AND item_type IN ('en', 'fr') AND NOT regexp_matches(title, '(?i)^the ') ORDER BY answered, paper_id LIMIT 30"),
    "join_01_enrichment": (join_01, f"WITH {PAPERS}, {ANSWERS}, e AS (SELECT paper_id, count(value) AS dims FROM answers GROUP BY 1) SELECT 'p' || doc_id AS paper_id, quality, title, year, dims FROM labels l LEFT JOIN papers p ON p.paper_id = 'p' || doc_id LEFT JOIN e ON e.paper_id = 'p' || doc_id"),
    "join_03_enrich_pairs": (join_03, "SELECT l_orderkey AS src, l_linenumber AS pos, l_partkey AS dst, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10"),
    "join_04_snapshot_changes": (join_04, "WITH b AS (SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS m FROM orders WHERE o_orderkey % 10 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority AS m FROM orders WHERE o_orderkey % 10 <> 1), j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'new' WHEN a.o_orderkey IS NULL THEN 'deleted' WHEN a.m <> b.m THEN 'modified' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey) SELECT o_orderkey, CASE WHEN change = 'unchanged' AND o_orderkey % 50 = 3 THEN 'modified' ELSE change END AS change FROM j"),
    "join_05_date_changes": (join_05, "WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS held FROM orders WHERE o_orderkey % 9 <> 0), o AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 8 <> 0) SELECT CASE WHEN s.o_orderkey IS NULL THEN 'new' WHEN o.o_orderkey IS NULL THEN 'deleted' WHEN coalesce(o_orderdate > try_cast(held AS TIMESTAMP) + INTERVAL 1 DAY, false) THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS n FROM s FULL JOIN o ON s.o_orderkey = o.o_orderkey GROUP BY 1"),
    "join_07_title_jaccard": (join_07, f"WITH a AS (SELECT doc_id, {T('line')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)), b AS (SELECT item_id, {T('line')} AS u FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)), j AS (SELECT doc_id, item_id, len(list_intersect(t, u)) AS k, len(t) AS nt, len(u) AS nu FROM a, b WHERE len(t) >= 3 AND len(u) >= 3 AND len(t) >= 0.85 * len(u) AND len(u) >= 0.85 * len(t)) SELECT doc_id, item_id, round(max(k / (nt + nu - k)), 6) AS similarity FROM j WHERE k / (nt + nu - k) >= 0.85 GROUP BY 1, 2"),
    "join_08_title_containment": (join_08, f"WITH i AS (SELECT item_id, {T('text')} AS t FROM benchmark), e AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM i), d AS (SELECT doc_id, unnest({T('text')}) AS w FROM documents), h AS (SELECT doc_id, item_id, n, count(*) AS k FROM d JOIN e USING (w) GROUP BY ALL) SELECT doc_id, item_id, CAST(CASE WHEN k / n > 0.9 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM h WHERE k >= least(3, n) AND k / n >= 0.85"),
    "join_10_direction_coverage": (join_10, f"WITH {PAPERS}, src AS (SELECT pos, paper_id, string_split(text, chr(10))[1] AS t FROM papers WHERE item_type = 'en'), {DIRECTIONS}, need AS (SELECT norm, unnest(list_distinct(tokens)) AS token, len(list_distinct(tokens)) AS need FROM d WHERE len(tokens) >= 2), idx AS (SELECT DISTINCT paper_id, unnest({sql_topic_tokens('text')}) AS token FROM papers WHERE item_type = 'en'), h AS (SELECT norm, need, paper_id, count(*) AS have FROM need JOIN idx USING (token) GROUP BY ALL HAVING have = need), k AS (SELECT norm, count(*) AS c FROM h GROUP BY 1) SELECT norm, mentions, array_to_string(tokens, ' ') AS tokens, coalesce(c, 0) AS covered FROM d LEFT JOIN k USING (norm) WHERE len(tokens) >= 2"),
    "join_11_doi_overlap": (join_11, f"WITH {PAPERS}, p AS (SELECT {NORM_DOI} AS d FROM papers), k AS (SELECT '10.1000/x' || s_suppkey AS d, true AS hit FROM supplier) SELECT count(*) AS total, count(*) FILTER (p.d IS NULL) AS without, count(*) FILTER (hit) AS overlap, count(*) FILTER (p.d IS NOT NULL AND hit IS NULL) AS fresh FROM p LEFT JOIN k ON p.d = k.d"),
    "join_12_similarity_context": (join_12, "SELECT c_custkey, s_suppkey, n_name, round(abs(c_acctbal - s_acctbal), 2) AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey ORDER BY score DESC, c_custkey, s_suppkey LIMIT 40"),
    "join_13_requirement_reasons": (join_13, "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' WHEN o_orderstatus = 'P' THEN 'modified' WHEN starts_with(o_orderpriority, '1') THEN 'forced' WHEN o_orderkey % 13 = 0 THEN 'pending' END AS reason FROM orders) SELECT reason, count(*) AS n, max(o_orderkey) AS last FROM r WHERE reason IS NOT NULL GROUP BY 1"),
    "join_14_scalar_subqueries": (join_14, "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders"),
    "join_15_title_check": (join_15, f"WITH {PAPERS}, x AS (SELECT paper_id, {T('title')} AS t, {T('substr(text, 1, 1000)')} AS x FROM papers), s AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_intersect(t, x)) / len(t) ELSE 0 END AS share FROM x) SELECT paper_id, CASE WHEN len(t) < 3 THEN true ELSE share >= 0.3 END AS matches, round(share, 6) AS share FROM s"),
    "join_16_orphans": (join_16, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "agg_01_summary": (agg_01, f"WITH {PAPERS} SELECT 'type' AS section, item_type AS key, count(*) AS n FROM papers GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM papers WHERE year IS NOT NULL GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'collection', c, count(*) AS n FROM (SELECT unnest(collections) AS c FROM papers) GROUP BY 2 ORDER BY n DESC, c LIMIT 20)"),
    "agg_01_totals": (agg_01_total, f"WITH {PAPERS} SELECT count(*) AS papers, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({WC}) AS BIGINT) AS words, count(year) AS dated FROM papers"),
    "agg_02_store_stats": (agg_02, "SELECT CAST(i AS INTEGER) AS label, coalesce(n, 0) AS n FROM range(10) r(i) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1) ON label = i"),
    "agg_03_distinct_keys": (agg_03, f"WITH {PAPERS} SELECT count(DISTINCT collection) AS collections, count(DISTINCT item_type) AS types, min(year) AS first, max(year) AS last FROM papers"),
    "agg_04_grouping_sets": (agg_04, "WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'no' END AS open FROM orders) SELECT coalesce('status:' || o_orderstatus, 'priority:' || o_orderpriority, 'open:' || open) AS key, count(*) AS n FROM o GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (open))"),
    "agg_05_confidence_bands": (agg_05, "SELECT event_type, CASE WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM events GROUP BY ALL"),
    "agg_06_group_plan": (agg_06, "SELECT p_brand, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey)[1:5], ',') AS first_ids FROM part GROUP BY 1"),
    "agg_07_topic_counts": (agg_07, f"WITH {TOPIC.format('p_type')} SELECT * FROM t"),
    "agg_08_years": (agg_08, f"WITH {PAPERS} SELECT year, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY 1"),
    "agg_09_nearest_rank": (agg_09, "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT list(n ORDER BY n) AS a FROM c) SELECT a[CAST(round_even((len(a) - 1) * 0.2, 0) AS INTEGER) + 1] AS threshold FROM l"),
    "agg_10_directions": (agg_10, f"WITH src AS (SELECT conv_id * 1000 + turn AS pos, 'p' || conv_id AS paper_id, text AS t FROM conversations), {DIRECTIONS} SELECT norm, direction, mentions, array_to_string(tokens, ' ') AS tokens FROM d"),
    "agg_11_token_index": (agg_11, f"WITH {PAPERS} SELECT token, count(DISTINCT paper_id) AS papers FROM (SELECT paper_id, unnest({sql_topic_tokens('title')}) AS token FROM papers WHERE item_type IN ('en', 'de')) GROUP BY 1 HAVING papers >= 2"),
    "agg_12_coverage": (agg_12, f"WITH {ANSWERS}, {COVER} SELECT paper_id, answered, round(coverage, 4) AS coverage, tier, missing_core FROM cov"),
    "agg_13_coverage_report": (agg_13, f"WITH {ANSWERS}, {COVER} SELECT t.tier, count(cov.paper_id) AS n, round(avg(coverage), 4) AS avg_coverage, count(*) FILTER (missing_core <> '') AS core_gaps FROM (VALUES ('full'), ('partial'), ('sparse'), ('minimal')) t(tier) LEFT JOIN cov ON cov.tier = t.tier GROUP BY 1"),
    "agg_14_centroids": (agg_14, "SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL"),
    "agg_15_text_tokens": (agg_15, f"WITH {PAPERS} SELECT collection, count(DISTINCT w) AS tokens FROM (SELECT collection, unnest({sql_topic_tokens('title')}) AS w FROM papers) GROUP BY 1"),
    "agg_16_field_rates": (agg_16, f"WITH {ANSWERS} SELECT dimension, count(*) AS total, count(value) AS given, round(count(value) / count(*), 6) AS rate FROM answers GROUP BY 1"),
    "agg_17_in_degree": (agg_17, "SELECT p_partkey, count(l_partkey) AS in_degree, 10 + 5 * count(l_partkey) AS size, count(l_partkey) >= 5 AS hub FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"),
    "agg_21_run_statistics": (agg_21, "SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS done, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS rate, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1"),
    "agg_22_clusters": (agg_22, "SELECT CASE WHEN label = 9 THEN -1 ELSE label END AS cluster, count(*) AS size, array_to_string(list(vec_id ORDER BY vec_id)[1:5], ',') AS first FROM embeddings GROUP BY 1"),
    "agg_25_compare_dimensions": (agg_25, f"WITH {ANSWERS}, u AS (SELECT conv_id, dimension, value AS a FROM answers WHERE provider = 'user'), b AS (SELECT conv_id, 'q' || lpad(CAST(turn AS VARCHAR), 2, '0') AS dimension, value AS b FROM answers WHERE provider = 'assistant') SELECT dimension, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_a, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_b, count(*) FILTER (a IS NULL AND b IS NULL) AS neither, count(*) FILTER (length(a) > length(b)) AS a_longer FROM u FULL JOIN b USING (conv_id, dimension) GROUP BY 1"),
    "agg_26_batch_summary": (agg_26, "SELECT l_returnflag, count(*) AS runs, round(avg(l_discount), 6) AS confidence, round(avg(l_quantity), 6) AS seconds FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1"),
    "agg_27_index_stats": (agg_27, f"WITH {PAPERS} SELECT count(*) AS papers, count(*) FILTER (starts_with({NORM_DOI}, '10.')) AS with_doi FROM papers"),
    "win_03_missing_days": (win_03, f"WITH d AS {DAYS} SELECT CAST(x AS INTEGER) AS day FROM (SELECT unnest(range(min(day), max(day) + 1)) AS x FROM d) WHERE x NOT IN (SELECT day FROM d)"),
    "win_04_islands": (win_04, f"WITH d AS {DAYS}, g AS (SELECT day, day - row_number() OVER (ORDER BY day) AS k FROM d) SELECT min(day) AS start, max(day) AS \"end\", count(*) AS length FROM g GROUP BY k"),
    "ml_14_gap_report": (ml_14, f"WITH {TOPIC.format('p_name')}, l AS (SELECT list(n ORDER BY n) AS a FROM t), h AS (SELECT greatest(2, a[CAST(round_even((len(a) - 1) * 0.2, 0) AS INTEGER) + 1]) AS threshold FROM l) SELECT label, n, evidence, threshold, round(least(0.5 * greatest(0, 1 - n / threshold) + 0.3 * least(len(string_split(evidence, ',')) / 3, 1) + 0.2 * least((SELECT count(*) FROM part) / 50, 1), 1), 3) AS confidence FROM t, h WHERE n <= threshold ORDER BY n, label LIMIT 50"),
    "set_01_touched_items": (set_01, "SELECT o_orderkey, min(p) AS first FROM (SELECT o_orderkey, 0 AS p FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'P') GROUP BY 1"),
    "set_03_difference": (set_03("minus"), f"WITH {PAPERS}, {ANSWERS} SELECT paper_id FROM papers EXCEPT SELECT paper_id FROM answers"),
    "set_03_intersection": (set_03("and"), f"WITH {PAPERS}, {ANSWERS} SELECT paper_id FROM papers INTERSECT SELECT paper_id FROM answers"),
    "set_03_union": (set_03("or"), f"WITH {PAPERS}, {ANSWERS} SELECT paper_id FROM papers UNION SELECT paper_id FROM answers"),
    "set_04_profile_diff": (set_04, "WITH p AS (SELECT * FROM part), o AS (SELECT 'd' || p_partkey AS dimension, p_brand AS s, p_name AS q, true AS e FROM p WHERE p_partkey % 9 <> 0), n AS (SELECT 'd' || p_partkey AS dimension, p_brand AS s, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS q, p_partkey % 13 <> 0 AS e FROM p WHERE p_partkey % 11 <> 0) SELECT dimension, CASE WHEN o.e IS NULL THEN 'added' WHEN n.e IS NULL THEN 'removed' WHEN o.e AND NOT n.e THEN 'disabled' WHEN o.q <> n.q OR o.s <> n.s THEN 'reworded' ELSE 'same' END AS change, coalesce(n.s, o.s) AS section FROM o FULL JOIN n USING (dimension)"),
    "set_05_merge_proposals": (set_05, "SELECT l_partkey, max(l_discount) AS confidence, arg_max(l_orderkey, (l_quantity, l_orderkey)) AS longest, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1"),
    "set_06_overlay": (set_06, f"WITH {ANSWERS}, o AS (SELECT paper_id, dimension, length(value) AS v FROM answers WHERE value IS NOT NULL AND turn < 4), n AS (SELECT paper_id, dimension, length(value) * 2 AS v FROM answers WHERE value IS NOT NULL AND turn >= 2) SELECT * FROM n UNION ALL SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.paper_id = o.paper_id AND n.dimension = o.dimension)"),
    "set_07_result_union": (set_07, "SELECT c_name AS name, 'primary' AS source FROM customer UNION ALL SELECT s_name, 'other' FROM supplier"),
    "set_02_08_collections_union": (set_08, f"WITH {PAPERS} SELECT title, string_agg(DISTINCT c, '|' ORDER BY c) AS collections FROM (SELECT title, unnest(collections) AS c FROM papers) GROUP BY 1"),
    "set_09_distinct_union": (set_09, "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier"),
    "str_06_jaccard": (str_06, f"WITH b AS (SELECT item_id, {T('text')} AS t FROM benchmark) SELECT a.item_id AS i, b.item_id AS j, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) ELSE 0 END, 6) AS similarity FROM b a JOIN b ON a.item_id + 1 = b.item_id"),
}
