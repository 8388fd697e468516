"""Sources, sinks, entity resolution, councils and classifiers (SRC, SNK, ER, AGG, ML, UDF) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenarc.functions import dims as D
from lumenarc.functions.text import overlap_coefficient, title_tokens, word_count
from lumenarc.operators import chunks as CH
from lumenarc.operators import classify as K
from lumenarc.operators import dedup as E
from lumenarc.operators import views as V
from lumenarc.plans.inputs import ANSWERS, PAPERS, answers, papers, sql_normal_title, sql_title_tokens, sql_words, table
from lumenarc.sources import bibliography as B
from lumenarc.sources import library as L
from lumenarc.sources import store as ST


def src_01(spark, sf):
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    items = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("type_id"))
    types = o.select(F.col("o_orderpriority").alias("type_id"), F.when(F.col("o_orderpriority").startswith("5"), "note").otherwise(F.col("o_orderpriority")).alias("type_name")).distinct()
    att = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attachment_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_returnflag").alias("content_type"))
    gone = o.where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("item_id"))
    return L.items_with_attachments(items, types, att, gone, ["R", "A"]).select("item_id", "attachment_id", "type_name")


def src_02(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("attachment_id"))
    return L.first_attachment(li)


def src_03(spark, sf):
    li = table(spark, sf, "lineitem")
    return L.all_source_items(li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"), "l_linenumber"), li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("item_id"), "l_linenumber"))


def src_04(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_brand", F.when(F.col("p_size") > 20, F.col("p_type")).alias("p_type"))
    eav = p.unpivot("item_id", ["p_name", "p_brand", "p_type"], "field", "value").where("value is not null")
    return L.pivot_attributes(eav, ["p_name", "p_brand", "p_type"])


def src_05(spark, sf):
    li = table(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") - 1).alias("order_index"), F.col("l_suppkey").cast("string").alias("last_name"), F.col("l_returnflag").alias("first_name"), (F.col("l_linenumber") % 2).alias("field_mode"), F.lit("author").alias("role"))
    return L.ordered_authors(c).select("item_id", F.array_join(F.transform("authors", lambda a: F.concat(a["order"].cast("string"), F.lit(":"), a["first_name"], F.lit(" "), a["last_name"])), "|").alias("authors"))


def src_06(spark, sf):
    from lumenarc.operators.graph import path_of

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    return path_of(nodes)


def src_07(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("item_id"))
    return L.item_lists(s, table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k", "names").select("item_id", F.array_join("names", ",").alias("names"))


def src_08(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.concat(F.lit("storage:"), "p_name", F.lit(".pdf")), F.lit("storage:../x"), F.lit("https://a.org/x"), F.concat(F.lit("/home/"), "p_brand"), F.lit("storage:/etc/x")), (F.col("p_partkey") % 5 + 1).cast("int")).alias("path"))
    return p.select("p_partkey", L.attachment_path(F.concat(F.lit("K"), "p_partkey"), "path", "/store").alias("file"))


def src_09(spark, sf):
    return V.rows_with(papers(spark, sf), "paper_id", "p17").select("paper_id", "title", "year", "doi")


def src_11(dialect):
    def run(spark, sf):
        p = table(spark, sf, "part")
        body = F.concat(F.lit("@article{k"), "p_partkey", F.lit(",\n  title = {The {Big} "), "p_name", F.lit(" \\& \\emph{more}},\n  author = {Lee, Ann and Bob B. Stone},\n  year = "), (F.lit(1990) + F.col("p_size") % 30).cast("string"), F.lit(",\n  keywords = \"x, y; x\",\n  mendeley-tags = {z},\n  groups = {A/B, A}\n}\n@comment{c, note = {no}\n}\n"))
        return B.parse_bibtex(p.select(body.alias("value")), dialect=dialect).select("paper_id", "title", F.array_join(F.transform("authors", lambda a: F.concat(a["first_name"], F.lit("/"), a["last_name"])), ";").alias("authors"), "publication_year", F.array_join("tags", ",").alias("tags"), F.array_join("collections", ",").alias("folders"), "item_type")

    return run


def src_14(spark, sf):
    p = table(spark, sf, "part")
    xml = F.concat(F.lit("<record><rec-number>"), "p_partkey", F.lit("</rec-number><titles><title> "), "p_name", F.lit("</title></titles><contributors><authors><author>Lee, Ann</author><author>Roe, J.</author></authors></contributors><dates><year>c. 2004</year></dates><keywords><keyword>a</keyword><keyword>b</keyword></keywords></record>"))
    r = B.parse_endnote(p.select(xml.alias("value")))
    return r.select("paper_id", "title", F.array_join(F.transform("authors", lambda a: F.concat(a["first_name"], F.lit(" "), a["last_name"])), ";").alias("authors"), "publication_year", F.size("tags").alias("tags"))


def src_15(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    docs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(2001).alias("year"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 4000).alias("added"))
    au = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("order_index"), F.col("l_returnflag").alias("first_name"), F.col("l_suppkey").cast("string").alias("last_name"))
    tags = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linestatus").alias("tag"))
    out = L.mendeley_papers(docs, au, tags, tags.select("document_id", F.col("tag").alias("path")))
    return out.select("paper_id", "title", F.unix_timestamp("date_added").alias("added"), F.size("authors").alias("authors"), F.array_join("tags", ",").alias("tags"))


def src_18(spark, sf):
    return V.first_rows(papers(spark, sf), ["paper_id"], 25).select("paper_id", "title")


def src_19(spark, sf):
    from lumenarc.operators.corpus import keep_last

    # Rows of one order and line stand in the order of the files.
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("pos"), "l_partkey", *place)
    return keep_last(li, "paper_id", "pos", ["file", "row"], keyless=True).drop("file", "row")


def src_20(spark, sf):
    return V.rows_with(table(spark, sf, "documents"), "doc_id", 3).select("doc_id", F.length("text").alias("chars"))


def src_21(spark, sf):
    return ST.text_manifest(papers(spark, sf))


def src_22(spark, sf):
    return D.registry(spark).groupBy("section").agg(F.count("*").alias("n"), F.count_if("core").alias("core"), F.min("alias").alias("first"))


def src_23(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.when(F.col("turn") % 5 == 4, F.lit("{bad")).otherwise(F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))).alias("content")).alias("message"))))
    return ST.session_messages(c.select(line.alias("value"))).select("role", F.length("text").alias("chars")).groupBy("role").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def src_24(spark, sf):
    return V.rows_with(table(spark, sf, "embeddings"), "label", 4).select("vec_id", F.size("embedding").alias("width"))


def src_26(spark, sf):
    from lumenarc.functions.text import normalize_title

    p = papers(spark, sf).select("paper_id", normalize_title("title").alias("k"))
    return p.groupBy("k").agg(F.min("paper_id").alias("first"), F.count("*").alias("n")).where("n > 1")


def src_27(spark, sf):
    short, full = F.substring("text", 1, 300), F.col("text")
    t = table(spark, sf, "documents").select("doc_id", ST.first_sufficient_text([("companion", short), ("plain", full)]).alias("t"))
    return t.select("doc_id", "t.tier")


def snk_02(spark, sf):
    from lumenarc.operators.corpus import upsert

    m = ST.text_manifest(papers(spark, sf))
    new = m.where("char_count % 3 = 0").withColumn("char_count", F.lit(-1).cast("long"))
    return upsert(m, new, "paper_id").select("paper_id", "char_count")


def snk_03(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")
    new = e.where("chunk_id % 4 = 0").select(F.col("chunk_id") + 2, F.lit(99).alias("label"), F.when(F.col("chunk_id") % 8 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("embedding")).toDF("chunk_id", "label", "embedding")
    return ST.add_chunks(e, new).select("chunk_id", "label")


def snk_04(spark, sf):
    p = papers(spark, sf).select("paper_id", "collection")
    return ST.delete_papers(p, p.where("collection = 'src1'"))


def snk_05_06(spark, sf):
    """Papers in a transaction log: one scope replaced, one deleted, folders compacted, what no version needs removed."""
    import uuid

    from lumenarc.sources.log import TableLog

    p = papers(spark, sf).select("paper_id", "collection")
    log = TableLog(spark, f"{ST.shared_folder(spark)}/lumenarc/log-{uuid.uuid4().hex}")
    log.create(p)
    log.append(p)
    scope = p.where("collection = 'src2'")
    log.replace(scope.withColumn("collection", F.lit("new")), scope, "paper_id")
    log.delete(spark.createDataFrame([("src3",)], "collection string"), "collection")
    log.compact()
    log.vacuum(keep=1, grace=0)
    return log.read()


def snk_05(spark, sf):
    p = papers(spark, sf).select("paper_id", "collection")
    new = p.withColumn("collection", F.lit("new"))
    return ST.replace_papers(p, new, p.where("collection = 'src2'"), p.where("collection = 'src3'"))


def snk_08(spark, sf):
    e = table(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "=").otherwise(""), F.col("p_name")).alias("name"), F.col("p_size").cast("string").alias("size"))
    return ST.export_csv(e)


def snk_09(spark, sf):
    p = table(spark, sf, "part")
    entry = ST.bibtex_entry(F.lit("article"), F.concat(F.lit("k"), "p_partkey"), title=F.concat("p_name", F.lit(" & co")), year=F.col("p_size").cast("string"), journal=F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")))
    return p.select("p_partkey", entry.alias("entry"))


def snk_11(spark, sf):
    p = papers(spark, sf)
    return p.select("paper_id", F.md5(ST.markdown_result(F.col("pos"), F.col("title"), F.col("year"), F.lit(0.5), F.col("text")).cast("binary")).alias("md"))


def snk_13(spark, sf):
    r = papers(spark, sf).select("paper_id", (F.col("pos") % 3 == 0).alias("success"), F.when(F.col("pos") % 2 == 0, "No PDF found").otherwise("timeout").alias("error"))
    return ST.skipped_report(r, papers(spark, sf).select("paper_id", "title"))


def snk_15(spark, sf):
    p = papers(spark, sf)
    return p.agg(F.count("*").alias("total"), F.sum(F.length("text")).alias("chars"), F.max("year").alias("latest"), F.lit("1.0").alias("schema_version"))


def er_02(spark, sf):
    p = papers(spark, sf)
    score = F.when(F.col("doi").isNotNull(), 2).otherwise(0) + F.when(F.col("year").isNotNull(), 1).otherwise(0) + F.size("collections")
    return E.survivors(p, score)


def er_03(spark, sf):
    li = table(spark, sf, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("source"), (F.col("l_partkey")).alias("target"), F.col("l_linenumber").alias("rank"))
    moved = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("paper_id"), (F.col("p_partkey") - 1).alias("survivor"))
    return E.redirect(edges, moved).groupBy("source").agg(F.count("*").alias("edges"), F.min("target").alias("first"))


def er_04(spark, sf):
    p = papers(spark, sf)
    rows = p.select("paper_id", F.col("collection").alias("source"), F.lower("doi").alias("doi"), (F.col("pos") % 100 / 100).alias("score"), F.when(F.col("pos") % 2 == 0, 1.0).otherwise(0.5).alias("weight"))
    return E.merge_by_doi(rows).select("paper_id", "doi")


def page_titles(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("pos"), "url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


def er_04_titles(spark, sf):
    """Pages as results of two indexes: one for each DOI and each group of similar titles."""
    doi = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("10.1000/X"), F.col("pos") % 50))
    rows = page_titles(spark, sf).select("pos", "url", doi.alias("doi"), "title", (F.col("pos") % 100 / 100).alias("score"), F.when(F.col("pos") % 2 == 0, 1.0).otherwise(0.5).alias("weight"))
    return E.merge_results(rows, 0.85).select("url", "title")


def er_05_join(spark, sf):
    """Pairs of pages' titles that are similar by their matching blocks."""
    return E.similar_titles(page_titles(spark, sf), 0.85).select("a", "b", F.round("ratio", 6).alias("ratio"))


def er_05(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(E.title_ratio("p_name", F.concat("p_name", F.lit(" x"))), 6).alias("ratio"), F.length("p_name").alias("n")).where("ratio > 0")


def er_06(spark, sf):
    from lumenarc.functions.text import normalize_title

    q = table(spark, sf, "part").select("p_brand", "p_partkey", normalize_title("p_name").alias("t"))
    same = lambda a, b: len(set(a["t"].split()) & set(b["t"].split())) >= 0.7 * len(set(a["t"].split()) | set(b["t"].split()))
    return E.greedy_distinct(q, ["p_brand"], ["p_partkey"], same, ["t"])


def er_07(spark, sf):
    p = papers(spark, sf)
    kind = F.when(F.col("pos") % 5 == 0, "webpage").when(F.col("pos") % 11 == 0, "attachment").otherwise("book")
    score = F.when(F.col("title") != "", 1).otherwise(0) + F.when(F.col("doi").isNotNull(), 1).otherwise(0) + F.when(F.col("year").isNotNull(), 1).otherwise(0)
    rows = p.select(F.col("pos").alias("item_id"), kind.alias("item_type"), "title", F.when(F.col("pos") % 3 == 0, F.col("doi")).alias("doi"), (F.col("pos") % 3).alias("n_pdfs"), (F.col("pos") % 3).alias("n_pdf_paths"), score.alias("metadata_score"), F.col("year").cast("string").alias("modified"), F.col("collection").alias("added"))
    return E.duplicate_groups(rows)


def er_08(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("cand"), (F.col("l_quantity") / 50).alias("ratio"), (F.col("l_linenumber") % 3).alias("cand_year"))
    return E.best_candidate(li, 0.85, F.lit(1))


def er_09(spark, sf):
    size = F.col("p_size")
    x = V.by_precedence((size < 10, "doi", 0.95), (size < 20, "isbn", 0.85), (size < 30, "title", 0.75))
    return table(spark, sf, "part").select(x.alias("x")).select("x.*").groupBy("source", "confidence").agg(F.count("*").alias("n"))


def er_10(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", title_tokens("text").alias("t"))
    pairs = b.alias("a").join(b.alias("b"), F.col("a.item_id") + 1 == F.col("b.item_id"))
    return pairs.select(F.col("a.item_id").alias("i"), F.col("b.item_id").alias("j"), F.round(overlap_coefficient("a.t", "b.t"), 6).alias("overlap"))


def er_10_matches(spark, sf):
    """Benchmark items as titles found on the web, matched with the documents' first lines."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("a"), title_tokens("text").alias("ta"))
    lines = papers(spark, sf).select(F.col("paper_id").alias("b"), title_tokens("title").alias("tb"))
    found = E.overlap_matches(items, lines)
    return found.select(F.col("a").alias("item_id"), F.col("b").alias("paper_id"), F.round("overlap", 6).alias("overlap"))


def er_11(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = V.resolve_targets(table(spark, sf, "customer"), o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "c_custkey")
    return found.groupBy("state").agg(F.count("*").alias("n"))


def council(name):
    def run(spark, sf):
        a = answers(spark, sf).withColumn("weight", F.when(F.col("provider") == "assistant", 1.0).otherwise(0.8)).withColumn("pos", F.col("turn")).withColumn("section", F.col("conv_id") % 3)
        return K.STRATEGIES[name](a, ["paper_id"]).select("paper_id", F.md5(F.col("value").cast("binary")).alias("value"))

    return run


def agg_18(spark, sf):
    a = answers(spark, sf).select("paper_id", "provider", F.concat(F.lit("q"), F.floor(F.col("turn") / 2).cast("string")).alias("dimension"), "value", "turn")
    a = a.groupBy("paper_id", "provider", "dimension").agg(F.max_by("value", "turn").alias("value"))
    return K.consensus(a, ["q0", "q1"], 40, 3).select("paper_id", "responses", F.round("confidence", 6).alias("confidence"))


def agg_20(spark, sf):
    p = table(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "?").otherwise("")).alias("question"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("rationale"), F.lit(None).cast("string").alias("hints"), F.element_at(F.array(*[F.lit(s) for s in ("causal", "comparative", "odd")]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("style"), F.col("p_brand").alias("gap_type"))
    return K.rank_questions(q).select("pos", F.round("combined", 6).alias("combined"), F.col("place").cast("long").alias("place"))


def agg_24(spark, sf):
    return V.find_patterns(table(spark, sf, "conversations"), r"\b(how|what|why|the)\b", "conv_id")


def ml_06(spark, sf):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("journalArticle", "book", "webpage", "document", "thesis", "other", "report")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", kinds.alias("item_type"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("A systematic review of "), "p_name")).otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_size") % 3 == 0, "10.1/x").alias("doi"), F.when(F.col("p_size") % 2 == 0, "J").alias("journal"), F.lit(None).cast("string").alias("isbn"), F.lit(None).cast("string").alias("url"))
    return p.select("p_partkey", K.classify_metadata().alias("v")).select("p_partkey", "v.type", "v.confidence")


def ml_07(spark, sf):
    p = papers(spark, sf).withColumn("meta", F.when(F.col("item_type") == "en", "research_paper").when(F.col("item_type") == "de", "book_monograph"))
    v = K.classify_text("text", "meta", word_count("text"), F.lit(1), F.lit(0))
    return p.select("paper_id", v.alias("v")).select("paper_id", "v.type", "v.confidence")


def ml_08(spark, sf):
    p = papers(spark, sf).withColumn("meta", F.when(F.col("item_type") == "en", K.verdict("research_paper", 0.9)).when(F.col("item_type") == "de", K.verdict("book_monograph", 0.6)).otherwise(K.verdict(None, 0.2)))
    v = K.classify(F.col("meta"), K.classify_text("text", F.col("meta.type"), word_count("text"), F.lit(1), F.lit(0)), F.length("text") > 300)
    return p.select("paper_id", v.alias("v")).select("paper_id", "v.type", "v.confidence")


def ml_09(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.element_at(F.array(F.lit(" theorem and proof of the lemma"), F.lit(" chart, plot"), F.lit(" scanned"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("t"), F.col("p_size"))
    v = K.extraction_intent(F.col("t"), F.lit("a title"), F.col("p_size") * 20, F.lit(3), pictures=True)
    return p.select("p_partkey", v.alias("v")).select("p_partkey", "v.intent", "v.confidence")


def ml_10(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.lit("fast"), F.lit("hybrid_ocr"), F.lit("hybrid_formula"), F.lit("hybrid_ocr_formula_picture"), F.lit(None).cast("string")), (F.col("p_partkey") % 5 + 1).cast("int")).alias("i"))
    return p.select("p_partkey", K.hybrid_profile("i").alias("profile"))


def ml_11(spark, sf):
    m = answers(spark, sf).where("value is not null").groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "value"))).alias("dims"))
    return m.select("paper_id", F.length(CH.overview("dims")).alias("overview"), CH.core_sentence("dims").alias("core"))


def ml_12(spark, sf):
    p = papers(spark, sf).withColumn("dims", F.create_map(F.lit("thesis"), F.when(F.col("pos") % 3 == 0, F.col("title")).otherwise("")))
    return p.select("paper_id", CH.highlight_summary("dims", F.when(F.col("pos") % 2 == 0, F.substring("text", 1, 600))).alias("summary"))


def ml_13(spark, sf):
    return V.ask_again(answers(spark, sf))


def ml_15(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", F.concat(F.lit('{"questions": ["Why '), "p_name", F.lit('?", "not a question", "How '), "p_brand", F.lit('?"]}')).alias("reply"))
    return r.select("p_partkey", F.explode(V.reply_questions("reply")).alias("question"))


def ml_17(spark, sf):
    p = table(spark, sf, "part")
    issues = K.validation_issues(F.col("p_size") / 50, F.col("p_partkey") % 10, F.col("p_partkey") % 4, F.col("p_size") / 100)
    return p.select("p_partkey", F.array_join(issues, ",").alias("issues"))


def ml_17_types(spark, sf):
    """Conversations' turns as answers of a document, validated by the rules of its type."""
    m = answers(spark, sf).where("value is not null").groupBy("paper_id", "conv_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "value"))).alias("dims"))
    kind = F.when(F.col("conv_id") % 4 == 0, "research_paper").when(F.col("conv_id") % 4 == 1, "review_paper").when(F.col("conv_id") % 4 == 2, "report")
    rows = m.join(papers(spark, sf).select("paper_id", "title", "text"), "paper_id", "left").withColumn("kind", kind)
    rows = rows.withColumn("confidence", F.col("conv_id") % 10 / 10).withColumn("claims", F.when(F.col("conv_id") % 3 == 0, "yes"))
    v = K.validate_extraction("dims", "kind", "confidence", "claims", "title", "text")
    return rows.select("paper_id", v.alias("v")).select("paper_id", "v.valid", F.array_join("v.issues", ",").alias("issues"), F.array_join("v.warnings", ",").alias("warnings"), "v.answered")


def triage_titles():
    """Part names as items' titles: with numbers, endings and names of offices that the columns choose."""
    size = F.col("p_size")
    shaped = F.when(size % 7 == 0, F.col("p_partkey").cast("string")).when(size % 7 == 1, F.concat("p_name", F.lit(".docx"))).when(size % 7 == 2, F.concat("p_type", F.lit(" Army "), "p_name")).when(size % 7 == 3, F.concat(F.lit("Activity "), size.cast("string"))).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    return shaped, F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("10.1000/"), "p_partkey"))


def ml_18(spark, sf):
    title, doi = triage_titles()
    return table(spark, sf, "part").select("p_partkey", K.triage(title, doi).alias("category"))


def ml_19(spark, sf):
    """Conversations' roles as what answered, or filled a gap: who is asked next."""
    c = table(spark, sf, "conversations")
    model = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("synthesis:"), F.when(F.col("role") == "user", "openai").otherwise("other"))).when(F.col("role") == "user", F.concat(F.lit("claude-"), "turn")).when(F.col("turn") % 2 == 0, F.concat(F.lit("gpt-"), "turn"))
    filled = F.when(F.col("conv_id") % 2 == 0, "anthropic")
    return c.groupBy(K.provider_of(model).alias("provider"), K.gap_fill_provider(F.lit(None).cast("string"), model, filled).alias("next")).agg(F.count("*").alias("n"))


def udf_02(spark, sf):
    from lumenarc.operators.llm_calls import call_model

    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    return call_model(p, "prompt", "reply")


def udf_08(spark, sf):
    return V.memory_rows(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn")


W = f"len({sql_words('text')})"
LONGEST = "arg_max(value, (length(value), -turn))"
DIMV = "max(value) FILTER (dimension = '{0}')"
META_TEXT = f"CASE WHEN {W} < 200 THEN 'non_academic' WHEN {W} > 40000 AND m = 'book_monograph' THEN 'book_monograph' WHEN {W} > 40000 THEN 'book_monograph' WHEN m IS NOT NULL THEN m WHEN {W} > 5000 THEN 'report' ELSE 'non_academic' END"
META_CONF = f"CASE WHEN {W} < 200 THEN 0.85 WHEN {W} > 40000 AND m = 'book_monograph' THEN 0.95 WHEN {W} > 40000 THEN 0.7 WHEN m IS NOT NULL THEN 0.8 WHEN {W} > 5000 THEN 0.5 ELSE 0.6 END"
NORM_DOI = "regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|(dx\\.)?doi\\.org/|doi:)\\s*', '')"

QUALITY = "least((CASE WHEN n BETWEEN 2 AND 5 THEN 0.3 WHEN n = 1 THEN 0.15 WHEN n > 5 THEN 0.2 ELSE 0 END + least(len(regexp_extract_all(value, '\\b\\d+(?:\\.\\d+)?%?\\b')) * 0.05, 0.2) + least(len(regexp_extract_all(value, '\\([A-Z][a-z]+(?:\\s+et\\s+al\\.?)?,?\\s*\\d{4}\\)')) * 0.1, 0.3)) * CASE WHEN length(value) < 50 THEN 0.5 ELSE 1 END, 1)"
CONSENSUS = f"""WITH {ANSWERS}, a AS (SELECT paper_id, provider, 'q' || (turn // 2) AS dimension, arg_max(value, turn) FILTER (value IS NOT NULL) AS value FROM answers GROUP BY ALL),
t AS (SELECT *, list_distinct(regexp_split_to_array(lower(value), '\\s+')) AS t FROM a WHERE value IS NOT NULL AND value <> '' AND dimension IN ('q0', 'q1')),
g AS (SELECT x.paper_id, x.dimension, avg(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))) AS s FROM t x JOIN t y ON x.paper_id = y.paper_id AND x.dimension = y.dimension AND x.provider < y.provider GROUP BY ALL),
f AS (SELECT paper_id, provider, count(*) FILTER (value IS NOT NULL AND value <> '') AS n FROM a GROUP BY ALL),
d AS (SELECT paper_id, count(*) AS responses, CASE WHEN max(n) > 0 THEN 1 - (max(n) - min(n)) / 40 ELSE 0.5 END AS spread FROM f GROUP BY 1),
m AS (SELECT paper_id, avg(s) AS agreement FROM (SELECT paper_id, s FROM g UNION ALL SELECT paper_id, spread FROM d WHERE responses >= 2) GROUP BY 1)
SELECT paper_id, responses, round(least(0.6 * responses / 3 + 0.4 * coalesce(agreement, 0.5), 1), 6) AS confidence FROM d LEFT JOIN m USING (paper_id)"""

QUERIES = {
    "src_01_items_with_attachments": (src_01, "SELECT o_orderkey AS item_id, l_orderkey * 10 + l_linenumber AS attachment_id, o_orderpriority AS type_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT starts_with(o_orderpriority, '5') AND l_returnflag IN ('R', 'A') AND o_orderkey % 20 <> 0 AND l_orderkey * 10 + l_linenumber NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0)"),
    "src_02_first_attachment": (src_02, "SELECT l_orderkey AS item_id, l_returnflag AS path, l_linenumber AS attachment_id, count(*) OVER w - 1 AS skipped FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) = 1"),
    "src_03_10_all_source_items": (src_03, "SELECT l_orderkey AS item_id, l_linenumber FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "src_04_attribute_pivot": (src_04, "SELECT p_partkey AS item_id, p_name, p_brand, CASE WHEN p_size > 20 THEN p_type END AS p_type FROM part"),
    "src_05_ordered_authors": (src_05, "SELECT l_orderkey AS item_id, string_agg(l_linenumber || ':' || CASE WHEN l_linenumber % 2 = 1 THEN '' ELSE l_returnflag END || ' ' || l_suppkey, '|' ORDER BY l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN '' ELSE l_returnflag END, CAST(l_suppkey AS VARCHAR)) AS authors FROM lineitem GROUP BY 1"),
    "src_06_gr_06_folder_paths": (src_06, "SELECT 'r' || r_regionkey AS id, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "src_07_collections_tags": (src_07, "SELECT s_suppkey AS item_id, n_name AS names FROM supplier JOIN nation ON n_nationkey = s_nationkey"),
    "src_08_attachment_paths": (src_08, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/store/K' || p_partkey || '/' || p_name || '.pdf' WHEN 3 THEN '/home/' || p_brand END AS file FROM part"),
    "src_09_get_paper": (src_09, f"WITH {PAPERS} SELECT paper_id, title, year, doi FROM papers WHERE paper_id = 'p17'"),
    "src_11_12_bibtex": (src_11("bibtex"), "SELECT 'bibtex_k' || p_partkey AS paper_id, 'The {Big} ' || p_name || ' & more' AS title, 'Ann/Lee;Bob B./Stone' AS authors, CAST(1990 + p_size % 30 AS INTEGER) AS publication_year, 'x,y' AS tags, '' AS folders, 'journalArticle' AS item_type FROM part"),
    "src_13_paperpile": (src_11("paperpile"), "SELECT 'bibtex_k' || p_partkey AS paper_id, 'The {Big} ' || p_name || ' & more' AS title, 'Ann/Lee;Bob B./Stone' AS authors, CAST(1990 + p_size % 30 AS INTEGER) AS publication_year, 'x,y' AS tags, 'A,B' AS folders, 'journalArticle' AS item_type FROM part"),
    "src_14_endnote": (src_14, "SELECT 'endnote_' || p_partkey AS paper_id, trim(p_name) AS title, 'Ann Lee;J. Roe' AS authors, 2004 AS publication_year, 2 AS tags FROM part"),
    "src_15_mendeley": (src_15, "SELECT 'mendeley_' || o_orderkey AS paper_id, o_orderpriority AS title, CAST(epoch(o_orderdate) AS BIGINT) * 4 AS added, (SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM lineitem WHERE l_orderkey = o_orderkey) AS authors, (SELECT string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey) AS tags FROM orders"),
    "src_18_iterate_limit": (src_18, f"WITH {PAPERS} SELECT paper_id, title FROM papers ORDER BY paper_id LIMIT 25"),
    "src_19_keep_last": (src_19, "SELECT l_orderkey AS paper_id, l_linenumber AS pos, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1"),
    "src_20_text_snapshot": (src_20, "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE doc_id = 3"),
    "src_21_text_manifest": (src_21, f"WITH {PAPERS} SELECT paper_id, length(text) AS char_count, {W} AS word_count, sha256(text) AS sha256 FROM papers"),
    "src_22_json_05_registry": (src_22, "SELECT * FROM (VALUES ('research_core', 5, 5, 'q01'), ('methodology', 5, 0, 'q06'), ('context', 6, 0, 'q11'), ('meta', 8, 0, 'q17'), ('scholarly', 7, 0, 'q25'), ('impact', 9, 0, 'q32')) t(section, n, core, first)"),
    "src_23_session_messages": (src_23, "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE turn % 5 <> 4 AND role IN ('user', 'assistant') GROUP BY 1"),
    "src_24_chunk_scan": (src_24, "SELECT vec_id, len(embedding) AS width FROM embeddings WHERE label = 4"),
    "src_26_keyed_views": (src_26, f"WITH {PAPERS}, k AS (SELECT paper_id, {sql_normal_title('title')} AS k FROM papers) SELECT k, min(paper_id) AS first, count(*) AS n FROM k GROUP BY 1 HAVING n > 1"),
    "src_27_text_cascade": (src_27, f"SELECT doc_id, CASE WHEN len({sql_words('substr(text, 1, 300)')}) >= 100 THEN 'companion' WHEN {W} >= 100 THEN 'plain' ELSE 'failed' END AS tier FROM documents"),
    "snk_02_manifest_upsert": (snk_02, f"WITH {PAPERS} SELECT paper_id, CASE WHEN length(text) % 3 = 0 THEN -1 ELSE length(text) END AS char_count FROM papers"),
    "snk_03_add_chunks": (snk_03, "WITH n AS (SELECT vec_id + 2 AS chunk_id FROM embeddings WHERE vec_id % 4 = 0 AND vec_id % 8 <> 0) SELECT chunk_id, 99 AS label FROM n UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM n)"),
    "snk_04_delete_papers": (snk_04, f"WITH {PAPERS} SELECT paper_id, collection FROM papers WHERE collection <> 'src1'"),
    "snk_05_replace_papers": (snk_05, f"WITH {PAPERS} SELECT paper_id, CASE WHEN collection = 'src2' THEN 'new' ELSE collection END AS collection FROM papers WHERE collection <> 'src3'"),
    "snk_05_06_transaction_log": (snk_05_06, f"WITH {PAPERS} SELECT paper_id, CASE WHEN collection = 'src2' THEN 'new' ELSE collection END AS collection FROM papers WHERE collection <> 'src3'"),
    "snk_08_csv_export": (snk_08, "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '''=' ELSE '' END || p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part"),
    "snk_09_10_bibtex_export": (snk_09, "SELECT p_partkey, '@article{k' || p_partkey || ',' || chr(10) || '  title = {' || p_name || ' \\& co},' || chr(10) || '  year = {' || p_size || '}' || CASE WHEN p_partkey % 2 = 0 THEN ',' || chr(10) || '  journal = {' || replace(p_brand, '#', '\\#') || '}' ELSE '' END || chr(10) || '}' AS entry FROM part"),
    "snk_11_markdown": (snk_11, f"WITH {PAPERS} SELECT paper_id, md5('### ' || pos || '. ' || title || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || ')' || chr(10) || chr(10) || 'Score: 50.0%' || chr(10) || chr(10) || '> ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS md FROM papers"),
    "snk_13_skipped_report": (snk_13, f"WITH {PAPERS} SELECT paper_id, pos % 3 = 0 AS success, 'No PDF found' AS error, title FROM papers WHERE pos % 3 <> 0 AND pos % 2 = 0"),
    "snk_01_15_metadata": (snk_15, f"WITH {PAPERS} SELECT count(*) AS total, CAST(sum(length(text)) AS BIGINT) AS chars, max(year) AS latest, '1.0' AS schema_version FROM papers"),
    "er_02_survivors": (er_02, f"WITH {PAPERS}, k AS (SELECT *, CASE WHEN {sql_normal_title('title')} IN ('', 'untitled') THEN chr(1) || paper_id ELSE {sql_normal_title('title')} END AS norm, CASE WHEN doi IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 1 ELSE 0 END + 2 AS s FROM papers), b AS (SELECT norm, arg_min(paper_id, (-s, pos)) AS survivor, count(*) AS group_size FROM k GROUP BY 1) SELECT paper_id, survivor, group_size FROM k JOIN b USING (norm)"),
    "er_03_redirect_edges": (er_03, "WITH e AS (SELECT CASE WHEN l_orderkey % 3 = 0 AND l_orderkey IN (SELECT p_partkey FROM part) THEN l_orderkey - 1 ELSE l_orderkey END AS source, CASE WHEN l_partkey % 3 = 0 AND l_partkey IN (SELECT p_partkey FROM part) THEN l_partkey - 1 ELSE l_partkey END AS target FROM lineitem) SELECT source, count(DISTINCT target) AS edges, min(target) AS first FROM e WHERE source <> target GROUP BY 1"),
    "er_04_merge_by_doi": (er_04, f"WITH {PAPERS}, r AS (SELECT paper_id, collection AS source, lower(doi) AS doi, (pos % 100) / 100 * CASE WHEN pos % 2 = 0 THEN 1.0 ELSE 0.5 END AS w FROM papers) SELECT paper_id, doi FROM r QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY doi ORDER BY w DESC, source, paper_id) = 1"),
    "er_04_merge_by_titles": (er_04_titles, None),
    "er_05_similar_titles": (er_05_join, None),
    "er_05_title_ratio": (er_05, "SELECT p_partkey, round(2 * length(p_name) / (2 * length(p_name) + 2), 6) AS ratio, CAST(length(p_name) AS INTEGER) AS n FROM part"),
    "er_06_greedy_questions": (er_06, None),
    "er_07_duplicate_groups": (er_07, f"WITH {PAPERS}, i AS (SELECT pos AS item_id, CASE WHEN pos % 5 = 0 THEN 'webpage' WHEN pos % 11 = 0 THEN 'attachment' ELSE 'book' END AS kind, CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN doi IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 1 ELSE 0 END AS meta, CAST(year AS VARCHAR) AS modified, collection AS added, CASE WHEN pos % 3 = 0 THEN regexp_replace(lower(trim(doi)), '^https?://(?:dx\\.)?doi\\.org/', '') END AS d, regexp_replace(lower(trim(coalesce(title, ''))), '\\s+', ' ', 'g') AS t FROM papers), g AS (SELECT *, CASE WHEN d IS NOT NULL THEN 'doi' ELSE 'title' END AS source, coalesce(d, t) AS group_key FROM i WHERE kind <> 'attachment'), k AS (SELECT *, count(*) OVER w AS n, bool_or(item_id % 3 > 0) OVER w AS has_pdf, bool_or(item_id % 3 = 0) OVER w AS has_none, first_value(item_id) OVER (PARTITION BY source, group_key ORDER BY kind <> 'webpage' DESC, item_id % 3 > 0 DESC, item_id % 3 = 1 DESC, meta DESC, modified DESC NULLS LAST, added DESC NULLS LAST, item_id) AS keeper FROM g WINDOW w AS (PARTITION BY source, group_key)) SELECT source, group_key, item_id, keeper FROM k WHERE n > 1 AND (source = 'doi' OR (has_pdf AND has_none))"),
    "er_08_best_candidate": (er_08, "WITH c AS (SELECT l_orderkey AS item, l_partkey AS cand, l_quantity / 50 AS ratio, l_linenumber % 3 AS y FROM lineitem), t AS (SELECT item, arg_max(cand, (ratio, cand)) AS ac, max(ratio) AS ar, arg_max(cand, (ratio, cand)) FILTER (y = 1) AS sc, max(ratio) FILTER (y = 1) AS sr FROM c GROUP BY 1) SELECT item, CASE WHEN sr >= 0.85 - 0.1 THEN sc WHEN ar >= 0.85 THEN ac END AS cand, CASE WHEN sr >= 0.85 - 0.1 THEN sr WHEN ar >= 0.85 THEN ar END AS ratio FROM t"),
    "er_09_source_precedence": (er_09, "SELECT CASE WHEN p_size < 10 THEN 'doi' WHEN p_size < 20 THEN 'isbn' WHEN p_size < 30 THEN 'title' ELSE 'none' END AS source, CAST(CASE WHEN p_size < 10 THEN 0.95 WHEN p_size < 20 THEN 0.85 WHEN p_size < 30 THEN 0.75 ELSE 0 END AS DOUBLE) AS confidence, count(*) AS n FROM part GROUP BY ALL"),
    "er_10_overlap_coefficient": (er_10, f"WITH b AS (SELECT item_id, {sql_title_tokens('text')} AS t FROM benchmark) SELECT a.item_id AS i, b.item_id AS j, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS overlap FROM b a JOIN b ON a.item_id + 1 = b.item_id"),
    "er_10_title_matches": (er_10_matches, f"WITH {PAPERS}, i AS (SELECT item_id, {sql_title_tokens('text')} AS t FROM benchmark), p AS (SELECT paper_id, {sql_title_tokens('title')} AS u FROM papers), o AS (SELECT item_id, paper_id, len(list_intersect(t, u)) / least(len(t), len(u)) AS x FROM i, p WHERE len(t) > 0 AND len(u) > 0) SELECT item_id, paper_id, round(x, 6) AS overlap FROM o WHERE x >= 0.5"),
    "er_11_resolve_targets": (er_11, "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'current' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'deleted' ELSE 'unmatched' END AS state, count(*) AS n FROM customer GROUP BY 1"),
    "agg_18_consensus": (agg_18, CONSENSUS),
    "agg_19_council_longest": (council("longest"), f"WITH {ANSWERS} SELECT paper_id, md5({LONGEST}) AS value FROM answers WHERE value IS NOT NULL AND value <> '' GROUP BY 1"),
    "agg_19_council_quality_weighted": (council("quality_weighted"), f"WITH {ANSWERS}, s AS (SELECT *, {QUALITY} * CASE WHEN provider = 'assistant' THEN 1.0 ELSE 0.8 END AS q FROM (SELECT *, len(list_filter(regexp_split_to_array(value, '[.!?]+'), lambda x: trim(x) <> '')) AS n FROM answers WHERE value IS NOT NULL AND value <> '')) SELECT paper_id, md5(arg_max(value, (round(q, 12), length(value), -turn))) AS value FROM s GROUP BY 1"),
    "agg_19_udf_01_council_union": (council("union"), None),
    "agg_20_rank_questions": (agg_20, "WITH q AS (SELECT p_partkey AS pos, p_name || CASE WHEN p_size % 2 = 0 THEN '?' ELSE '' END AS q, p_size, ['causal', 'comparative', 'odd'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS style, p_brand AS gap FROM part), s AS (SELECT pos, 0.6 * least(0.3 + CASE WHEN p_size % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_size > 25 THEN 0.2 ELSE 0 END + CASE WHEN length(q) BETWEEN 50 AND 200 THEN 0.2 WHEN length(q) BETWEEN 30 AND 250 THEN 0.1 ELSE 0 END + CASE style WHEN 'causal' THEN 0.15 WHEN 'comparative' THEN 0.12 ELSE 0 END, 1) + 0.4 * (1 / count(*) OVER (PARTITION BY gap) + 1 / count(*) OVER (PARTITION BY style)) / 2 AS c FROM q) SELECT pos, round(c, 6) AS combined, row_number() OVER (ORDER BY round(c, 12) DESC, pos) AS place FROM s"),
    "agg_24_find_patterns": (agg_24, "SELECT k, count(DISTINCT conv_id) AS sessions, count(*) AS hits FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '\\b(how|what|why|the)\\b', 1)) AS k FROM conversations) GROUP BY 1"),
    "ml_06_classify_metadata": (ml_06, "WITH p AS (SELECT *, ['journalArticle', 'book', 'webpage', 'document', 'thesis', 'other', 'report'][CAST(p_partkey % 7 + 1 AS INTEGER)] AS k, p_size % 3 = 0 AS d, p_size % 2 = 0 AS j, p_size % 5 = 0 AS r FROM part) SELECT p_partkey, CASE k WHEN 'journalArticle' THEN CASE WHEN r THEN 'review_paper' ELSE 'research_paper' END WHEN 'book' THEN 'book_monograph' WHEN 'webpage' THEN CASE WHEN d THEN 'research_paper' ELSE 'reference_material' END WHEN 'document' THEN CASE WHEN d THEN 'research_paper' END WHEN 'thesis' THEN 'thesis' WHEN 'report' THEN 'report' ELSE CASE WHEN d AND j THEN 'research_paper' END END AS type, CAST(CASE k WHEN 'journalArticle' THEN CASE WHEN r THEN 0.9 ELSE round(0.85 + CASE WHEN d THEN 0.05 ELSE 0 END + CASE WHEN j THEN 0.05 ELSE 0 END, 2) END WHEN 'webpage' THEN CASE WHEN d THEN 0.7 ELSE 0.55 END WHEN 'document' THEN CASE WHEN d THEN 0.6 ELSE 0.3 END WHEN 'other' THEN CASE WHEN d AND j THEN 0.7 ELSE 0.2 END ELSE 0.85 END AS DOUBLE) AS confidence FROM p"),
    "ml_07_classify_text": (ml_07, f"WITH {PAPERS}, x AS (SELECT *, CASE item_type WHEN 'en' THEN 'research_paper' WHEN 'de' THEN 'book_monograph' END AS m FROM papers) SELECT paper_id, {META_TEXT} AS type, CAST({META_CONF} AS DOUBLE) AS confidence FROM x"),
    "ml_08_classify_cascade": (ml_08, f"WITH {PAPERS}, x AS (SELECT *, CASE item_type WHEN 'en' THEN 'research_paper' WHEN 'de' THEN 'book_monograph' END AS m FROM papers) SELECT paper_id, CASE WHEN m = 'research_paper' THEN m WHEN length(text) > 300 THEN {META_TEXT} WHEN m IS NOT NULL THEN m ELSE 'research_paper' END AS type, CAST(CASE WHEN m = 'research_paper' THEN 0.9 WHEN length(text) > 300 THEN {META_CONF} WHEN m IS NOT NULL THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence FROM x"),
    "ml_09_extraction_intent": (ml_09, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'hybrid_formula' WHEN 1 THEN 'hybrid_picture' WHEN 2 THEN 'hybrid_ocr' ELSE 'fast' END AS intent, CAST(CASE WHEN p_partkey % 4 = 3 THEN 0.55 ELSE 0.76 END AS DOUBLE) AS confidence FROM part"),
    "ml_10_hybrid_profile": (ml_10, "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'hybrid:backend=docling:client=auto:ocr=1:formula=0:picture=0' WHEN 2 THEN 'hybrid:backend=docling:client=full:ocr=0:formula=1:picture=0' WHEN 3 THEN 'hybrid:backend=docling:client=full:ocr=1:formula=1:picture=0' ELSE 'fast' END AS profile FROM part"),
    "ml_11_template_summaries": (ml_11, None),
    "ml_12_highlights": (ml_12, f"WITH {PAPERS} SELECT paper_id, substr(CASE WHEN pos % 3 = 0 AND trim(title) <> '' THEN title WHEN pos % 2 = 0 AND trim(substr(text, 1, 600)) <> '' THEN substr(text, 1, 600) ELSE 'No summary available' END, 1, 500) AS summary FROM papers"),
    "ml_13_gap_fill_scope": (ml_13, f"WITH {ANSWERS}, h AS (SELECT paper_id, dimension FROM answers GROUP BY ALL HAVING count(value) = 0) SELECT paper_id, string_agg(dimension, ',' ORDER BY dimension) AS ask_again FROM h GROUP BY 1"),
    "ml_15_parse_questions": (ml_15, "SELECT p_partkey, 'Why ' || p_name || '?' AS question FROM part UNION ALL SELECT p_partkey, 'How ' || p_brand || '?' FROM part"),
    "ml_17_validation": (ml_17, "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 4 > 0 THEN 'missing_required' END, CASE WHEN p_size / 50 < 0.5 THEN 'low_confidence' WHEN p_size / 50 < 0.7 THEN 'medium_confidence' END, CASE WHEN p_partkey % 10 < 5 THEN 'few_dimensions' END, CASE WHEN p_size / 100 < 0.3 THEN 'title_mismatch' END) AS issues FROM part"),
    "ml_17_validation_by_type": (ml_17_types, f"""WITH {PAPERS}, {ANSWERS}, d AS (SELECT DISTINCT paper_id, conv_id, dimension, trim(value) <> '' AS ok FROM answers WHERE value IS NOT NULL), h AS (SELECT paper_id, conv_id, CAST(count(*) FILTER (ok) AS INTEGER) AS answered, list(dimension) FILTER (ok) AS q, CASE conv_id % 4 WHEN 0 THEN 'research_paper' WHEN 1 THEN 'review_paper' WHEN 2 THEN 'report' END AS kind, (conv_id % 10) / 10 AS conf FROM d GROUP BY 1, 2),
    w AS (SELECT h.*, p.text, p.title, list_distinct(regexp_extract_all(lower(coalesce(p.title, '')), '[a-z]{{3,}}')) AS t, list_distinct(regexp_extract_all(lower(substr(p.text, 1, 1000)), '[a-z]{{3,}}')) AS x,
    CASE kind WHEN 'review_paper' THEN ['q02_thesis', 'q03_key_claims'] WHEN 'report' THEN ['q04_evidence', 'q22_contribution'] ELSE ['q02_thesis', 'q07_methods', 'q04_evidence'] END AS must, CASE kind WHEN 'review_paper' THEN ['q07_methods', 'q22_contribution'] WHEN 'report' THEN ['q03_key_claims'] ELSE ['q01_research_question', 'q22_contribution'] END AS should FROM h LEFT JOIN papers p USING (paper_id)),
    i AS (SELECT paper_id, answered, CASE WHEN text IS NOT NULL AND title <> 'Untitled' AND len(t) >= 3 AND len(list_intersect(t, x)) / len(t) < 0.3 THEN ['title mismatch'] ELSE [] END || CASE WHEN conf < 0.5 THEN ['confidence too low'] ELSE [] END || list_transform(list_filter(must, lambda f: NOT list_contains(coalesce(q, []), f[1:3])), lambda f: 'missing required: ' || f) || CASE WHEN kind IS NULL AND conv_id % 3 <> 0 THEN ['missing key claims'] ELSE [] END AS issues,
    CASE WHEN conf < 0.7 THEN ['low confidence'] ELSE [] END || list_transform(list_filter(should, lambda f: NOT list_contains(coalesce(q, []), f[1:3])), lambda f: 'missing recommended: ' || f) || CASE WHEN answered < 5 THEN ['few dimensions'] ELSE [] END AS warnings FROM w)
    SELECT paper_id, len(issues) = 0 AS valid, array_to_string(issues, ',') AS issues, array_to_string(warnings, ',') AS warnings, answered FROM i"""),
    "ml_18_triage": (ml_18, "SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 'A' WHEN p_size % 7 = 0 THEN 'E' WHEN p_size % 7 IN (1, 3) THEN 'D' WHEN p_size % 7 = 2 THEN 'C' ELSE 'B' END AS category FROM part"),
    "ml_19_providers": (ml_19, "WITH m AS (SELECT CASE WHEN turn % 3 = 0 THEN CASE WHEN role = 'user' THEN 'openai' END WHEN role = 'user' THEN 'anthropic' WHEN turn % 2 = 0 THEN 'openai' END AS provider, conv_id FROM conversations) SELECT provider, CASE provider WHEN 'openai' THEN 'anthropic' WHEN 'anthropic' THEN 'openai' ELSE CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END END AS next, count(*) AS n FROM m GROUP BY ALL"),
    "udf_02_model_calls": (udf_02, "SELECT p_partkey, p_name AS prompt, 'echo: ' || p_name AS reply FROM part"),
    "udf_08_memory_rows": (udf_08, "SELECT DISTINCT 'session' || conv_id AS name, 'session' AS kind FROM conversations WHERE role = 'user' UNION ALL SELECT 'session' || conv_id || '->' || turn, 'relation' FROM conversations WHERE role = 'user'"),
}
