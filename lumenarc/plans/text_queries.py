"""String, web, identifier, date, hash and JSON expressions (STR, WEB, DT, HASH, MATH, JSON, PRJ) on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lumenarc.functions import ids as I
from lumenarc.functions import text as T
from lumenarc.functions.dims import ALIASES
from lumenarc.operators import views as V
from lumenarc.plans.inputs import ANSWERS, PAPERS, answers, papers, sql_normal_title, sql_title_tokens, sql_topic_tokens, sql_words, table


def docs(spark, sf):
    return table(spark, sf, "documents")


def str_01(spark, sf):
    return papers(spark, sf).select("paper_id", T.normalize_title("title").alias("norm"))


def tokens(fn, column):
    def run(spark, sf):
        rows = papers(spark, sf)
        return rows.select("paper_id", F.array_join(F.array_sort(F.array_distinct(fn(column))), " ").alias("tokens"))

    return run


def str_05(spark, sf):
    return table(spark, sf, "part").select(T.normalize_label(F.concat(F.lit("  "), F.upper("p_type"), F.lit("  "))).alias("label")).distinct()


def noise():
    return F.concat(F.col("text"), F.lit("\n  12  \nshort\n\n\n\nA line with  two   blanks and a hyphen-\nated word\nPage 7 of the report"))


NOISE_SQL = "text || chr(10) || '  12  ' || chr(10) || 'short' || repeat(chr(10), 4) || 'A line with  two   blanks and a hyphen-' || chr(10) || 'ated word' || chr(10) || 'Page 7 of the report'"
CLEAN_SQL = "regexp_replace(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '(?m)^\\s*\\d+\\s*$', '', 'g'), '(?im)^.{{0,80}}(page \\d+|^\\d+$).{{0,80}}$', '', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: length(trim(x)) >= 10 OR trim(x) = ''), chr(10)), '^\\s+|\\s+$', '', 'g')"


def str_07(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.clean_text(noise()).cast("binary")).alias("clean"), F.length(T.clean_text(noise())).alias("chars"))


def str_08(spark, sf):
    s = docs(spark, sf).select("doc_id", T.text_stats(noise()).alias("s"))
    return s.select("doc_id", "s.char_count", "s.word_count", "s.line_count", "s.page_count", F.round("s.avg_line_length", 6).alias("avg_line_length"))


def marks():
    return F.concat(F.when(F.col("doc_id") % 2 == 0, "Abstract. ").otherwise(""), F.col("text"), F.when(F.col("doc_id") % 3 == 0, " Methods and RESULTS; discussion").otherwise(""))


MARKS_SQL = "CASE WHEN doc_id % 2 = 0 THEN 'Abstract. ' ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN ' Methods and RESULTS; discussion' ELSE '' END"


def str_09(spark, sf):
    return docs(spark, sf).select("doc_id", T.section_marker_count(marks()).alias("markers"), T.is_valid_extraction("text").alias("valid"))


def str_10(spark, sf):
    body = F.concat(F.lit("Abstract: "), "text", F.lit("\n\nNext"))
    found = docs(spark, sf).select("doc_id", T.extract_sections(body).alias("m"))
    return found.select("doc_id", F.length(F.col("m")["abstract"]).alias("chars"))


def str_11(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.truncate_middle("text", 1000, 300, 200).cast("binary")).alias("cut"))


def str_12(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncate_at_word("text", 50).alias("cut"))


def rated():
    return F.element_at(F.array(*[F.lit(x) for x in ("rated 4", "3/5 overall", "an Excellent study", "rigorous work", "weak and very weak", "fundamentally flawed", "plain", "")]), (F.col("p_partkey") % 8 + 1).cast("int"))


RATED_SQL = "['rated 4', '3/5 overall', 'an Excellent study', 'rigorous work', 'weak and very weak', 'fundamentally flawed', 'plain', ''][CAST(p_partkey % 8 + 1 AS INTEGER)]"


def str_13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.quality_rating(rated()).alias("rating"))


def str_14(spark, sf):
    hits = docs(spark, sf).select("doc_id", F.explode(T.keyword_context("text", "idiot", 40, 3)).alias("h"))
    return hits.select("doc_id", F.col("h.start").cast("long").alias("start"), F.length("h.context").alias("chars"))


def str_14_count(spark, sf):
    n = (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("idiot"), F.lit("")))) / 5
    return docs(spark, sf).select("doc_id", F.least(n.cast("long"), F.lit(3)).alias("hits")).where("hits > 0")


def str_15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.highlight(F.concat("p_name", F.lit(" <b> & ")), "green blue steel").alias("html"))


def str_16(spark, sf):
    u = F.concat(F.when(F.col("doc_id") % 3 == 0, "doi:").otherwise("https://dx.doi.org/"), F.lit("10.1000/A"), F.col("doc_id") % 100)
    d = I.normalize_doi(u)
    return docs(spark, sf).select("doc_id", F.concat(F.lit("https://doi.org/"), d).alias("url"), u.rlike("^https?://[^\\s]+$").alias("safe"))


def str_17(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("="), "p_name", F.lit(" & 5% #1_[x]*")).alias("v"))
    return p.select("p_partkey", T.escape("v", T.BIBTEX_ESCAPES[1:]).alias("bibtex"), T.escape("v", T.MARKDOWN_ESCAPES).alias("markdown"), T.csv_guard("v").alias("csv"))


def str_18(spark, sf):
    names = F.split("c_name", "#")
    c = table(spark, sf, "customer").withColumn("a", F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 4 == 1, F.array(names[0])).when(F.col("c_custkey") % 4 == 2, names).otherwise(F.array(names[0], names[1], F.lit("Third"))))
    who = I.author_string("a")
    apa = F.concat_ws(" ", who, F.concat(F.lit("("), F.lit(1990) + F.col("c_custkey") % 30, F.lit(").")), F.concat("c_mktsegment", F.lit(".")))
    return c.select("c_custkey", who.alias("authors"), apa.alias("apa"))


def str_19(spark, sf):
    return papers(spark, sf).select("paper_id", T.slug("title", 40).alias("slug"))


def cited():
    return F.concat(F.lit("See 12 and 3.5% (Smith, 2019). "), "text")


CITED_SQL = "'See 12 and 3.5% (Smith, 2019). ' || text"


def str_20(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(T.score_quality(cited()), 6).alias("score"))


def str_21(spark, sf):
    t = F.concat(F.lit("see arXiv: 2103."), F.lpad((F.col("doc_id") % 99999).cast("string"), 5, "0"), F.lit(" and https://doi.org/10.1234/AbC."), F.col("doc_id"), F.lit(". published 2011-04-05"))
    d = docs(spark, sf).select("doc_id", t.alias("t"))
    return d.select("doc_id", I.arxiv_id("t").alias("arxiv"), F.array_join(I.find_dois("t"), ",").alias("dois"), I.year_of(F.regexp_extract("t", "published (.*)$", 1)).alias("year"))


def str_22(spark, sf):
    from lumenarc.sources.folder import parse_filename

    name = F.element_at(F.array(F.concat(F.lit("Smith and Lee - 2019 - "), "p_name", F.lit(".pdf")), F.concat(F.lit("Smith_2018_"), "p_brand", F.lit(".PDF")), F.concat(F.lit("2017_Jones_"), "p_brand", F.lit(".pdf")), F.concat("p_name", F.lit(".pdf"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", parse_filename(name).alias("f"))
    return p.select("p_partkey", "f.authors", "f.year", "f.title")


def str_23(spark, sf):
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(F.lit("12. 2015 "), "p_name", F.lit("_2020")), r"^[\d.\s]+", ""), r"[_\s]*\(?(?:19|20)\d{2}\)?$", ""), "_", " ")
    return table(spark, sf, "part").select("p_partkey", F.trim(t).alias("query"))


def str_24(spark, sf):
    return docs(spark, sf).where("lang = 'en'").select("doc_id", T.first_sentence_with("text", F.lit("idiot")).alias("context")).where("context is not null")


def str_25(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.strip_fence(F.concat(F.lit("```json\n{\"k\": "), "p_partkey", F.lit("}\n```"))).alias("body"))


def web_01(spark, sf):
    t = T.html_to_text("html")
    return table(spark, sf, "pages").select("page_id", F.md5(t.cast("binary")).alias("text_md5"), T.word_count(t).alias("words"), (T.word_count(t) >= 50).alias("usable"))


def web_02(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.preprint_html_to_text("html").cast("binary")).alias("text_md5"))


def er_01(spark, sf):
    raw = F.element_at(F.array(*[F.concat(F.lit(p), F.lit("10.5/AB"), F.col("p_partkey")) for p in ("https://doi.org/", "http://dx.doi.org/", "doi.org/", "dx.doi.org/", "doi:", "DOI: ", " ", "x")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", I.normalize_doi(raw).alias("doi"))


def dt_01(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("s"))
    return e.select("event_id", F.unix_timestamp(I.parse_time("s")).alias("seconds"))


def dt_02(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("s"))
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("s") * 4000).otherwise(F.col("s"))
    return o.select("o_orderkey", F.unix_timestamp(I.epoch_time(v)).alias("seconds"))


def dt_03(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 5 HOURS")).cast("timestamp").alias("reset"))
    return e.select("event_id", F.unix_timestamp("reset").alias("reset_at"))


def hash_01(spark, sf):
    return papers(spark, sf).select("paper_id", I.fingerprint("title", "year", "doi").alias("mark"))


def hash_02(spark, sf):
    return table(spark, sf, "part").select("p_partkey", I.content_hash("p_name", F.lit("model"), F.lit("1.0"), "p_size").alias("mark"))


def hash_03(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"))


def math_01(spark, sf):
    from lumenarc.operators.search import cosine, norm, squared_distance

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = e.alias("a").join(e.alias("b"), F.col("a.vec_id") + 1 == F.col("b.vec_id"))
    d = squared_distance("a.e", "b.e")
    return pairs.select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"), F.round(cosine("a.e", "b.e"), 6).alias("cosine"), F.round(F.sqrt(d), 6).alias("l2"), F.round(1 / (1 + d), 6).alias("score"), F.round(norm("a.e"), 6).alias("norm"))


def math_02(spark, sf):
    price = spark.createDataFrame([("R", 3.0, 15.0), ("A", 0.8, 4.0), ("N", 0.1, 0.4)], "l_returnflag string, inp double, out double")
    return V.call_costs(table(spark, sf, "lineitem"), price, "l_returnflag", "l_quantity", "l_linenumber").withColumn("cost", F.round("cost", 4))


def prj_01(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("n.d.").alias("y"), F.concat("p_brand", F.lit(" , ,"), "p_type").alias("c"))
    got = V.parsed_metadata("y", "c")
    return p.select("p_partkey", got["year"].alias("year"), F.array_join(got["collections"], "|").alias("collections"))


def prj_02(spark, sf):
    section = F.when(F.col("dimension") <= "q05", "core").when(F.col("dimension") <= "q10", "methodology").otherwise("rest")
    return V.answers_by_section(answers(spark, sf), section)


def prj_03(spark, sf):
    from lumenarc.functions.dims import dimension_value

    m = answers(spark, sf).where("value is not null").groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "value"))).alias("dims"))
    return m.select("paper_id", F.length(dimension_value("dims", "thesis")).alias("thesis_chars"), F.length(dimension_value("dims", "q03_key_claims")).alias("claims_chars"))


def prj_05(spark, sf):
    p = papers(spark, sf)
    title = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "Untitled").otherwise(F.col("title"))
    return p.select(F.concat_ws("_", "paper_id", "collection").alias("id"), title.alias("title"), I.year_of(F.concat(F.lit("in "), "year")).alias("year"))


def prj_07(spark, sf):
    from lumenarc.operators.chunks import make_chunks

    p = papers(spark, sf).select("paper_id", F.col("text").alias("abstract"), "year")
    dims = answers(spark, sf).where("value is not null").groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "value"))).alias("dimensions"))
    return make_chunks(p.join(dims, "paper_id", "left")).select("chunk_id", "chunk_type", F.length("text").alias("chars"), "year")


def json_01(spark, sf):
    from lumenarc.functions.dims import normalize_value

    e = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.lit("  plain "), F.lit("[\"a\", \"b\", \"a\", \" \"]"), F.lit("{\"x\": 1, \"y\": true}"), F.lit("null"), F.lit("12")), (F.col("p_partkey") % 5 + 1).cast("int")).alias("v"))
    return e.select("p_partkey", normalize_value("v").alias("value"))


def json_01_nested(spark, sf):
    """Answers nested three deep, made of the parts' columns."""
    from lumenarc.functions.dims import normalize_value

    inner = F.struct(F.col("p_size").alias("unit_size"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("note"))
    whole = F.struct(F.array("p_brand", "p_brand", "p_type").alias("made_by"), F.array(inner, inner).alias("details"), F.col("p_name").alias("summary"), F.lit(None).cast("string").alias("empty"))
    return table(spark, sf, "part").select("p_partkey", normalize_value(F.to_json(whole, {"ignoreNullFields": "false"})).alias("value"))


def json_02(spark, sf):
    from lumenarc.functions.dims import canonical_map

    m = answers(spark, sf).where("value is not null").groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "value"))).alias("dims"))
    c = m.select("paper_id", canonical_map("dims").alias("c"))
    return c.select("paper_id", F.size("c").alias("n"), F.array_join(F.array_sort(F.map_keys("c")), ",").alias("names"))


def json_06(spark, sf):
    e = table(spark, sf, "events")
    keys = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.size(keys).alias("n"), F.array_join(F.slice(F.array_sort(F.map_keys(keys)), 1, 3), ",").alias("names"))


def json_07(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("q01_name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("q02_brand"), F.col("p_type").alias("q03_type"))
    return V.flat_to_dimensions(p, "p_partkey", ["q01_name", "q02_brand", "q03_type"])


def json_08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.proposal_id("p_name").alias("id"), V.clamped((F.col("p_size") - 10) / 30).alias("confidence"))


Q = sql_words("text")
ALIAS_ROWS = ", ".join(f"('{a}', '{d}')" for a, d in ALIASES.items())
DIMS_LIMIT = ANSWERS
HTML_BASE = "regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gs')"
for _names in (T.UNREAD, T.FRAME):
    HTML_BASE = f"regexp_replace({HTML_BASE}, '<(?:{_names})[^>]*>.*?</(?:{_names})>', ' ', 'gis')"
HTML_BASE = f"regexp_replace(regexp_replace({HTML_BASE}, '<(?:{T.BLOCKS})[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"


def sql_entities(expr: str, pairs) -> str:
    return reduce(lambda x, e: f"replace({x}, '{e[0]}', '{e[1] if e[1] != chr(39) else chr(39) * 2}')", pairs, expr)


HTML_SQL = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({sql_entities(HTML_BASE, T.ENTITIES)}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), 'Page saved with SingleFile', ' ', 'gi'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
PRE = "coalesce(html, '')"
for _name in ("script", "style", "nav", "header", "footer"):
    PRE = f"regexp_replace({PRE}, '<{_name}[^>]*>.*?</{_name}>', ' ', 'gis')"
PRE_SQL = f"regexp_replace(regexp_replace(regexp_replace({sql_entities(f'regexp_replace(regexp_replace({PRE}, {chr(39)}<(?:p|div|br|h[1-6]|li|tr)[^>]*>{chr(39)}, chr(10), {chr(39)}gi{chr(39)}), {chr(39)}<[^>]+>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})', (T.ENTITIES[-1], *T.ENTITIES[:-1]))}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"

QUERIES = {
    "str_01_normalize_title": (str_01, f"WITH {PAPERS} SELECT paper_id, {sql_normal_title('title')} AS norm FROM papers"),
    "str_02_title_tokens": (tokens(T.title_tokens, "title"), f"WITH {PAPERS} SELECT paper_id, array_to_string(list_sort({sql_title_tokens('title')}), ' ') AS tokens FROM papers"),
    "str_03_text_tokens": (tokens(T.text_tokens, "title"), f"WITH {PAPERS} SELECT paper_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda w: w NOT IN ({', '.join(chr(39) + w + chr(39) for w in T.TEXT_STOPWORDS)})))), ' ') AS tokens FROM papers"),
    "str_04_topic_tokens": (tokens(T.topic_tokens, "title"), f"WITH {PAPERS} SELECT paper_id, array_to_string(list_sort(list_distinct({sql_topic_tokens('title')})), ' ') AS tokens FROM papers"),
    "str_05_normalize_label": (str_05, "SELECT DISTINCT lower(trim(regexp_replace('  ' || upper(p_type) || '  ', '\\s+', ' ', 'g'))) AS label FROM part"),
    "str_07_clean_text": (str_07, f"SELECT doc_id, md5({CLEAN_SQL.format(NOISE_SQL)}) AS clean, CAST(length({CLEAN_SQL.format(NOISE_SQL)}) AS INTEGER) AS chars FROM documents"),
    "str_08_text_stats": (str_08, f"WITH d AS (SELECT doc_id, {NOISE_SQL} AS text FROM documents), l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS f FROM d) SELECT doc_id, length(text) AS char_count, len({Q}) AS word_count, len(string_split(text, chr(10))) AS line_count, 1 AS page_count, round(list_sum(list_transform(f, lambda x: length(x))) / len(f), 6) AS avg_line_length FROM l"),
    "str_09_section_markers": (str_09, f"SELECT doc_id, len(list_distinct(regexp_extract_all(lower({MARKS_SQL}), '\\b(abstract|introduction|methods?|methodology|results?|discussion|conclusion|references|bibliography)\\b', 1))) AS markers, len({Q}) >= 100 AS valid FROM documents"),
    "str_10_extract_sections": (str_10, None),
    "str_11_truncate_for_llm": (str_11, "SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 300) || chr(10) || chr(10) || '[... content truncated ...]' || chr(10) || chr(10) || substr(text, CAST(length(text) // 2 - 200 + 1 AS INTEGER), 400) || chr(10) || chr(10) || '[... content truncated ...]' || chr(10) || chr(10) || right(text, 200) END) AS cut FROM documents"),
    "str_12_truncate_at_word": (str_12, "WITH c AS (SELECT doc_id, text, substr(text, 1, 200) AS t FROM documents), g AS (SELECT *, CASE WHEN contains(t, ' ') THEN 200 - instr(reverse(t), ' ') ELSE -1 END AS p FROM c) SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN p > 160 THEN substr(t, 1, p) ELSE t END || '...' END AS cut FROM g"),
    "str_13_quality_rating": (str_13, f"WITH r AS (SELECT p_partkey, lower({RATED_SQL}) AS v FROM part) SELECT p_partkey, CASE WHEN v = '' THEN 0 WHEN regexp_matches(v, '\\d\\s*/\\s*5') THEN CAST(regexp_extract(v, '(\\d)\\s*/\\s*5', 1) AS INTEGER) WHEN regexp_matches(v, '(?:rat(?:ed?|ing)|score)[:\\s]+\\d') THEN CAST(regexp_extract(v, '(?:rat(?:ed?|ing)|score)[:\\s]+(\\d)', 1) AS INTEGER) WHEN regexp_matches(v, 'excellent|outstanding|exceptional') THEN 5 WHEN regexp_matches(v, 'strong|high quality|rigorous|well-designed') THEN 4 WHEN regexp_matches(v, 'weak|poor|limited|significant flaws') THEN 2 WHEN regexp_matches(v, 'very weak|fundamentally flawed') THEN 1 ELSE 3 END AS rating FROM r"),
    "str_14_fulltext_context": (str_14, "WITH p AS (SELECT doc_id, text, string_split(lower(text), 'idiot') AS a FROM documents WHERE contains(lower(text), 'idiot')), i AS (SELECT doc_id, text, a, unnest(range(1, least(len(a), 4))) AS k FROM p), s AS (SELECT doc_id, length(text) AS n, CAST(list_sum(list_transform(a[1:k], lambda x: length(x))) + 5 * (k - 1) AS BIGINT) AS start FROM i) SELECT doc_id, start, CAST(least(n, start + 45) - greatest(start - 40, 0) AS INTEGER) AS chars FROM s"),
    "str_14_hit_counts": (str_14_count, "SELECT doc_id, least(CAST((length(text) - length(replace(lower(text), 'idiot', ''))) / 5 AS BIGINT), 3) AS hits FROM documents WHERE contains(lower(text), 'idiot')"),
    "str_15_highlight": (str_15, "SELECT p_partkey, regexp_replace(replace(replace(replace(p_name || ' <b> & ', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\b(green|steel|blue)\\b', '<mark>\\1</mark>', 'gi') AS html FROM part"),
    "str_16_doi_url": (str_16, "SELECT doc_id, 'https://doi.org/10.1000/a' || (doc_id % 100) AS url, doc_id % 3 <> 0 AS safe FROM documents"),
    "str_17_escapes": (str_17, "WITH p AS (SELECT p_partkey, '=' || p_name || ' & 5% #1_[x]*' AS v FROM part) SELECT p_partkey, replace(replace(replace(replace(replace(v, '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_') AS bibtex, replace(replace(replace(replace(replace(replace(v, '\\', '\\\\'), '`', '\\`'), '*', '\\*'), '_', '\\_'), '[', '\\['), ']', '\\]') AS markdown, '''' || v AS csv FROM p"),
    "str_18_citations": (str_18, "WITH c AS (SELECT *, string_split(c_name, '#') AS n FROM customer), w AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN n[1] WHEN 2 THEN CASE WHEN len(n) = 1 THEN n[1] WHEN len(n) = 2 THEN n[1] || ' and ' || n[2] ELSE n[1] || ' et al.' END ELSE n[1] || ' et al.' END AS authors FROM c) SELECT c_custkey, authors, authors || ' (' || (1990 + c_custkey % 30) || '). ' || c_mktsegment || '.' AS apa FROM w"),
    "str_19_slugs": (str_19, f"WITH {PAPERS} SELECT paper_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9\\s_-]', '', 'g'), '[\\s_-]+', '_', 'g'), 1, 40), '^_+|_+$', '', 'g') AS slug FROM papers"),
    "str_20_quality_score": (str_20, f"WITH d AS (SELECT doc_id, {CITED_SQL} AS t FROM documents), s AS (SELECT *, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x) <> '')) AS n FROM d) SELECT doc_id, round(least((CASE WHEN n BETWEEN 2 AND 5 THEN 0.3 WHEN n = 1 THEN 0.15 WHEN n > 5 THEN 0.2 ELSE 0 END + least(len(regexp_extract_all(t, '\\b\\d+(?:\\.\\d+)?%?\\b')) * 0.05, 0.2) + least(len(regexp_extract_all(t, '\\([A-Z][a-z]+(?:\\s+et\\s+al\\.?)?,?\\s*\\d{{4}}\\)')) * 0.1, 0.3)) * CASE WHEN length(t) < 50 THEN 0.5 ELSE 1 END, 1), 6) AS score FROM s"),
    "str_21_identifiers": (str_21, "SELECT doc_id, '2103.' || lpad(CAST(doc_id % 99999 AS VARCHAR), 5, '0') AS arxiv, '10.1234/abc.' || doc_id AS dois, 2011 AS year FROM documents"),
    "str_22_src_16_filenames": (str_22, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Smith and Lee' WHEN 1 THEN 'Smith' WHEN 2 THEN 'Jones' END AS authors, CASE p_partkey % 4 WHEN 0 THEN '2019' WHEN 1 THEN '2018' WHEN 2 THEN '2017' END AS year, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN p_name ELSE p_brand END AS title FROM part"),
    "str_23_search_titles": (str_23, "SELECT p_partkey, trim(p_name) AS query FROM part"),
    "str_24_context_sentences": (str_24, "WITH s AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: contains(lower(x), 'idiot')) AS h FROM documents WHERE lang = 'en') SELECT doc_id, substr(trim(h[1]) || '.', 1, 200) AS context FROM s WHERE len(h) > 0"),
    "str_25_strip_fence": (str_25, "SELECT p_partkey, '{\"k\": ' || p_partkey || '}' AS body FROM part"),
    "web_01_html_text": (web_01, f"WITH t AS (SELECT page_id, {HTML_SQL} AS text FROM pages) SELECT page_id, md5(text) AS text_md5, len({Q}) AS words, len({Q}) >= 50 AS usable FROM t"),
    "web_02_preprint_html": (web_02, f"SELECT page_id, md5({PRE_SQL}) AS text_md5 FROM pages"),
    "er_01_normalize_doi": (er_01, "SELECT p_partkey, CASE WHEN p_partkey % 8 <> 7 THEN '10.5/ab' || p_partkey END AS doi FROM part"),
    "dt_01_iso_parse": (dt_01, "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM events"),
    "dt_02_epoch_detection": (dt_02, "WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN s * 4000 > 1e12 THEN s * 4 ELSE s * 4000 END ELSE s END AS seconds FROM o"),
    "dt_03_window_arithmetic": (dt_03, "SELECT event_id, CAST(epoch(date_trunc('second', ts + INTERVAL 5 HOUR)) AS BIGINT) AS reset_at FROM events"),
    "hash_01_fingerprint": (hash_01, f"WITH {PAPERS} SELECT paper_id, sha256(coalesce('=' || title, '~') || '|' || coalesce('=' || year, '~') || '|' || coalesce('=' || doi, '~')) AS mark FROM papers"),
    "hash_02_content_hash": (hash_02, "SELECT p_partkey, substr(sha256(p_name || ':model:1.0:' || p_size), 1, 16) AS mark FROM part"),
    "hash_03_src_21_text_hash": (hash_03, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
    "math_01_gr_04_vector_math": (math_01, "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_distance(a.e, b.e), 6) AS l2, round(1 / (1 + pow(list_distance(a.e, b.e), 2)), 6) AS score, round(sqrt(list_dot_product(a.e, a.e)), 6) AS norm FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id"),
    "math_02_cost_estimate": (math_02, "SELECT l_returnflag, round(sum(l_quantity * i / 1000 + l_linenumber * o / 1000), 4) AS cost, count(*) AS calls FROM lineitem JOIN (VALUES ('R', 3.0::DOUBLE, 15.0::DOUBLE), ('A', 0.8, 4.0), ('N', 0.1, 0.4)) p(f, i, o) ON f = l_returnflag GROUP BY 1"),
    "prj_01_enriched_projection": (prj_01, "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS year, p_brand || '|' || trim(p_type) AS collections FROM part"),
    "prj_02_sections": (prj_02, f"WITH {ANSWERS} SELECT paper_id, CASE WHEN dimension <= 'q05' THEN 'core' WHEN dimension <= 'q10' THEN 'methodology' ELSE 'rest' END AS section, count(*) AS fields, string_agg(dimension, ',' ORDER BY dimension) AS names FROM answers WHERE value IS NOT NULL GROUP BY ALL"),
    "prj_03_dimension_value": (prj_03, f"WITH {ANSWERS} SELECT paper_id, CAST(max(length(value)) FILTER (dimension = 'q02') AS INTEGER) AS thesis_chars, CAST(max(length(value)) FILTER (dimension = 'q03') AS INTEGER) AS claims_chars FROM answers WHERE value IS NOT NULL GROUP BY 1"),
    "prj_05_derived_columns": (prj_05, f"WITH {PAPERS} SELECT paper_id || '_' || collection AS id, CASE WHEN trim(title) = '' THEN 'Untitled' ELSE title END AS title, year FROM papers"),
    "prj_07_udf_05_chunks": (prj_07, f"WITH {PAPERS}, {ANSWERS}, c AS (SELECT paper_id || '_abstract' AS chunk_id, 'abstract' AS chunk_type, text AS t, year FROM papers UNION ALL SELECT p.paper_id || '_dim_' || dimension, 'dim_' || dimension, value, year FROM papers p JOIN answers a ON a.paper_id = p.paper_id), g AS (SELECT *, substr(t, 1, 2048) AS cut FROM c WHERE trim(t) <> ''), h AS (SELECT *, CASE WHEN contains(cut, ' ') THEN 2048 - instr(reverse(cut), ' ') ELSE -1 END AS gap FROM g) SELECT chunk_id, chunk_type, CAST(CASE WHEN length(t) <= 2048 THEN length(t) WHEN gap > 2048 * 0.8 THEN gap + 3 ELSE 2051 END AS INTEGER) AS chars, year FROM h"),
    "json_01_normalize_value": (json_01, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'a; b' WHEN 2 THEN 'x: 1; y: true' WHEN 3 THEN NULL ELSE '12' END AS value FROM part"),
    "json_01_nested_values": (json_01_nested, "SELECT p_partkey, p_name || '; made by: ' || p_brand || '; ' || p_type || '; details: ' || CASE WHEN p_size % 2 = 0 THEN p_type || '; ' ELSE '' END || 'unit size: ' || p_size AS value FROM part"),
    "json_02_prj_04_canonical_map": (json_02, f"WITH {ANSWERS}, k AS (SELECT * FROM (VALUES {ALIAS_ROWS}) k(alias, name)) SELECT paper_id, CAST(count(DISTINCT name) AS INTEGER) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM answers JOIN k ON dimension = alias WHERE value IS NOT NULL GROUP BY 1"),
    "json_06_parse_props": (json_06, "WITH k AS (SELECT event_id, list_sort(json_keys(props)) AS k FROM events) SELECT event_id, CAST(len(k) AS INTEGER) AS n, array_to_string(k[1:3], ',') AS names FROM k"),
    "json_07_migrate_flat": (json_07, "SELECT p_partkey, 'q01_name' AS dimension, p_name AS value FROM part UNION ALL SELECT p_partkey, 'q02_brand', p_brand FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'q03_type', p_type FROM part"),
    "json_08_proposals": (json_08, "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS id, least(greatest((p_size - 10) / 30, 0), 1) AS confidence FROM part"),
}
