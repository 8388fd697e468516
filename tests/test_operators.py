import pytest
from pyspark.sql import functions as F

from lumenarc import api
from lumenarc.operators import classify as K
from lumenarc.operators import corpus as C
from lumenarc.operators import dedup as E
from lumenarc.operators import graph as G
from lumenarc.operators import search as S
from lumenarc.sources import bibliography as B
from lumenarc.sources import folder, library, store
from lumenarc.streaming import events as EV
from lumenarc.streaming import sync as SY


def test_rrf_scores_and_ties(spark):
    r = spark.createDataFrame([(0, 1, "b"), (0, 2, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "variant int, rank int, paper_id string")
    got = [(x["paper_id"], round(x["score"], 9)) for x in S.fuse_rankings(r).orderBy("rank").collect()]
    assert got == [("a", round(1 / 61 + 1 / 62, 9)), ("b", round(1 / 61 + 1 / 62, 9)), ("c", round(1 / 63, 9))]


def test_collections_filter_comes_after_the_cut(spark):
    chunks = spark.createDataFrame([(i, f"p{i}", "t", 2000, "x" if i else "y", [float(i), 0.0]) for i in range(6)], "chunk_id int, paper_id string, chunk_type string, year int, collection string, embedding array<double>")
    assert S.nearest(chunks, [0.0, 0.0], 3, ["x"]).count() == 2
    assert [r["paper_id"] for r in S.search_papers(chunks, [0.0, 0.0], 2).orderBy("rank").collect()] == ["p0", "p1"]


@pytest.mark.parametrize(("year", "want"), [(2020, 0.2), (2025, 0.2), (2015, 0.1), (2012, 0.2 * (0.5 - 3 / 20)), (2000, 0.0), (None, 0.0)])
def test_recency_boost(spark, year, want):
    df = spark.createDataFrame([(year,)], "y int")
    assert df.select(S.recency_boost("y", 0.2, 2020).alias("r")).first()["r"] == pytest.approx(want)


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 8))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(40)], "id int, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -1)
    want = {(i, int(j)) for i in range(40) for j in np.argsort(-sims[i])[:5] if sims[i, j] > 0}
    for parts in (1, 3):
        assert {(r["src"], r["dst"]) for r in S.neighbours(df, "id", 5, parts).collect()} == want


def test_year_rules_differ(spark):
    p = spark.createDataFrame([(None,), (0,), (1999,), (2005,)], "year int")
    assert p.where(C.year_open("year", 2000, None)).count() == 3
    assert p.where(C.year_closed("year", 2000, None)).count() == 1


def test_coverage_tiers(spark):
    a = spark.createDataFrame([("p", f"q{i:02d}", "x" if i < 7 else "") for i in range(1, 11)], "paper_id string, dimension string, value string")
    r = C.coverage(a, 10, ["q01", "q09"]).first()
    assert (r["answered"], r["tier"], r["missing_core"]) == (6, "partial", "q09")
    assert C.coverage(a, 10, [], blank_counts=True).first()["tier"] == "full"


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 5, 6)], "n int")
    for q in (0.0, 0.1, 0.2, 0.3, 0.5, 0.9, 1.0):
        assert C.nearest_rank(df, "n", q).first()["threshold"] == sorted(range(1, 7))[int(round(5 * q))]


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 6, 8, 9)], "y int")
    assert sorted((r["start"], r["end"], r["length"]) for r in C.islands(df, "y").collect()) == [(1, 3, 3), (6, 6, 1), (8, 9, 2)]
    assert sorted(r["y"] for r in C.missing_values(df, "y").collect()) == [4, 5, 7]


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "k string, m string")
    b = spark.createDataFrame([("y", "2"), ("z", "1"), ("w", "1")], "k string, m string")
    assert {r["k"]: r["change"] for r in C.snapshot_diff(a, b, "k", "m", b.where("k = 'z'")).collect()} == {"x": "deleted", "y": "modified", "z": "modified", "w": "new"}


def greedy(pairs, cap):
    used, out = {}, set()
    for s, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            out.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return out


def test_capped_edges_equal_the_greedy_scan(spark):
    import random

    rng = random.Random(2)
    pairs = [(rng.randint(0, 9) / 10, a, b) for a in range(14) for b in range(a + 1, 14)]
    df = spark.createDataFrame(pairs, "score double, source int, target int")
    got = {(r["source"], r["target"]) for r in G.capped_edges(df, 3).collect()}
    assert got == greedy(pairs, 3)


def test_short_titles_never_match(spark):
    p = spark.createDataFrame([("a", "Short Title"), ("b", "A long enough title about graph kernels")], "paper_id string, title string")
    texts = spark.createDataFrame([("t", "it cites a long enough title about graph kernels and Short Title")], "paper_id string, text string")
    edges = G.title_edges(texts, G.title_index(p)).collect()
    assert [(e["source"], e["target"], e["confidence"]) for e in edges] == [("t", "b", 0.9)]


def test_survivor_has_the_best_score(spark):
    p = spark.createDataFrame([("a", 1, "Same title!", 0), ("b", 2, "same  title", 2), ("c", 3, "untitled", 5), ("d", 4, "Untitled", 5)], "paper_id string, pos int, title string, s int")
    assert {r["paper_id"]: r["survivor"] for r in E.survivors(p, F.col("s")).collect()} == {"a": "b", "b": "b", "c": "c", "d": "d"}


def test_title_ratio():
    assert E.sequence_ratio(" Deep Nets", "deep nets ") == 1.0
    assert E.sequence_ratio("a longer title here", "a longer title here x") > 0.8
    assert E.sequence_ratio("", "x") == 0.0


def test_council_strategies(spark):
    a = spark.createDataFrame([("k", 0, "Short one.", 2.0), ("k", 1, "A much longer answer of words. It has two sentences.", 1.0), ("k", 2, "", 3.0)], "id string, pos int, value string, weight double")
    assert K.council_longest(a, ["id"]).first()["value"].startswith("A much longer")
    assert K.council_union(a, ["id"]).first()["value"] == "Short one. A much longer answer of words. It has two sentences."


def test_bibtex(spark):
    text = '@article{k1,\n title = {On {Graphs} \\& more},\n author = {Lee, Ann and Bob Stone},\n year = 2001,\n keywords = "a, b; a"\n}\n@comment{x,\n y = {z}\n}\n@book{k2,\n title = "B"\n}\n'
    rows = B.parse_bibtex(spark.createDataFrame([(text,)], "value string")).orderBy("paper_id").collect()
    assert [r["paper_id"] for r in rows] == ["bibtex_k1", "bibtex_k2"]
    assert rows[0]["title"] == "On {Graphs} & more"
    assert [(a["first_name"], a["last_name"], a["order"]) for a in rows[0]["authors"]] == [("Ann", "Lee", 1), ("Bob", "Stone", 2)]
    assert (rows[0]["publication_year"], rows[0]["tags"], rows[1]["item_type"]) == (2001, ["a", "b"], "book")


@pytest.mark.parametrize(("name", "want"), [("A. Lee - 2019 - On x.pdf", ("A. Lee", "2019", "On x")), ("Lee_2019_T.pdf", ("Lee", "2019", "T")), ("2019_Lee_T.pdf", ("Lee", "2019", "T")), ("T only.PDF", (None, None, "T only"))])
def test_filenames(spark, name, want):
    r = spark.createDataFrame([(name,)], "n string").select(folder.parse_filename("n").alias("f")).first()["f"]
    assert (r["authors"], r["year"], r["title"]) == want


def test_read_source_and_store(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"papers": [{"paper_id": "x", "title": "old"}, {"paper_id": "x", "title": "new"}, {"title": "none"}]}')
    assert [(r["paper_id"], r["title"]) for r in library.read_source(spark, "json", str(tmp_path / "a.json")).collect()] == [("x", "new")]
    with pytest.raises(ValueError, match="unknown provider"):
        library.read_source(spark, "nowhere", "x")
    v = store.Versions(spark, str(tmp_path / "v"))
    v.commit(spark.range(3))
    v.commit(spark.range(5))
    assert v.read().count() == 5
    v.rollback()
    assert v.read().count() == 3


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = EV.tumbling(stream, "6 hours").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted((r["start"], r["event_type"], r["n"]) for r in spark.table("windows").collect())
    assert got == sorted((r["start"], r["event_type"], r["n"]) for r in EV.tumbling(events, "6 hours").collect())


def test_upsert_stream(spark, tmp_path):
    write = EV.upsert_to(str(tmp_path / "t"), "k")
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    assert sorted(map(tuple, store.Versions(spark, str(tmp_path / "t")).read().collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_sync_plan(spark):
    frame = lambda *c: spark.createDataFrame([(x, c) for x, c in c], "k string, change string")
    none, some = frame(("a", "unchanged")), frame(("a", "new"), ("b", "deleted"), ("c", "modified"))
    held = {"schema": 1, "source": "s", "embedding": "e", "extraction": "x"}
    plan = lambda m=held, w=held, c=some, **k: SY.plan_sync(m, w, c, **k)
    first = plan("missing")
    assert (first.mode, first.full_rebuild, first.clear_vectors, first.noop) == ("full", True, True, False)
    assert plan("corrupt").reasons == ["manifest is corrupt"]
    assert plan("missing", requested="update").mode == "invalid"
    assert (plan().mode, plan().noop, plan().counts) == ("update", False, {"new": 1, "deleted": 1, "modified": 1})
    assert plan(c=none).noop
    owed = spark.createDataFrame([("embeddings", "a")], "stage string, paper_id string")
    assert not plan(c=none, pending=owed).noop and plan(c=none, pending=owed.limit(0)).noop
    for change in ({"schema": 2}, {"embedding": "f"}, {"schema": 0}):
        other = plan(w=held | change)
        assert other.mode == "full" and len(other.reasons) == 1
        assert plan(w=held | change, requested="update").mode == "invalid"
    drift = plan(w=held | {"extraction": "y"}, c=none)
    assert drift.mode == "update" and drift.noop and len(drift.advisories) == 1
    assert plan(consistent=False).full_extraction and plan(consistent=False).mode == "full"
    assert plan(store_problem="vectors are gone").reasons == ["vectors are gone"]
    assert plan(incremental=False).mode == "full" and plan(incremental=False, requested="update").mode == "invalid"
    asked = plan(requested="full", targets=2, unmatched=["z", "y"])
    assert not asked.clear_vectors and asked.reasons[0] == "unmatched targets: y, z" and len(asked.reasons) == 2
    assert plan(limit="new").counts == {"new": 1} and plan(limit="delete").counts == {"deleted": 1}


def test_duplicate_groups(spark):
    rows = [
        (1, "webpage", "A  Title", None, 1, 1, 5, "2024", "2020"), (2, "book", "a title", None, 0, 0, 3, "2020", "2020"), (3, "attachment", "a title", None, 0, 0, 3, "2020", "2020"),
        (4, "book", "No Pdf", "", 0, 0, 3, "2020", "2020"), (5, "book", "no pdf", None, 0, 0, 3, "2020", "2020"), (6, "book", "x", "10.1/A", 1, 2, 5, "2024", "2020"),
        (7, "book", "y", "https://doi.org/10.1/a", 1, 1, 3, "2020", "2020"), (8, "book", "z", "10.1/a", 0, 0, 5, "2025", "2025"), (9, "book", "alone", "10.1/b", 1, 1, 5, "2", "2"), (10, "book", "y", "10.1/A", 1, 1, 3, "2020", "2020"),
    ]
    df = spark.createDataFrame(rows, "item_id long, item_type string, title string, doi string, n_pdfs int, n_pdf_paths int, metadata_score int, modified string, added string")
    got = {(r["source"], r["group_key"], r["item_id"], r["keeper"]) for r in E.duplicate_groups(df).collect()}
    assert got == {("title", "a title", 1, 2), ("title", "a title", 2, 2), *(("doi", "10.1/a", i, 7) for i in (6, 7, 8, 10))}


def test_triage_and_gap_fill_providers(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c).first()[0]
    cases = {"KMBT_12": "E", "12345": "E", "PDF": "E", "Activity 3": "D", "notes.DOCX": "D", "A concept map of it": "D", "the Army manual": "C", "Emerging Tech: a factsheet": "C", "Deep learning": "B", "10.1234/abc in a title": "B"}
    for title, want in cases.items():
        assert one(K.triage("t", "d"), t=title, d=None) == want
    assert one(K.triage("t", "d"), t="KMBT_1", d="10.1/x") == "A" and one(K.triage("t", "d"), t=None, d="") == "B"
    for model, want in {"Claude-3": "anthropic", "gpt-5": "openai", "o3-mini": "openai", "gemini-2": "google", "qwen2": "ollama", "synthesis:openai": "openai", "synthesis:ollama": None, "chatgpt": None, "opus": None, "": None}.items():
        assert one(K.provider_of("m"), m=model) == want
    of = lambda e, m, f, **k: one(K.gap_fill_provider("e", "m", "f", **k), e=e, m=m, f=f)
    assert of("claude-3", "gpt-5", None) == "openai" and of(None, "gpt-5", None) == "anthropic"
    assert of("gemini-2", None, "anthropic") == "openai" and of("llama3", None, "google") == "anthropic" and of(None, None, None) == "anthropic"
    assert of("gpt-5", None, None, override="google") == "google"


def test_validation_by_type(spark):
    full = {"q02": "t", "q07_methods": "m", "evidence": "e", "q01": "q", "q22_contribution": "c"}
    rows = [(1, full, "research_paper", 0.9, None), (2, {"q02": "t"}, "review_paper", 0.6, None), (3, {}, "non_academic", 0.4, None), (4, full, None, 0.9, "c"), (5, full, None, 0.9, None), (6, {"q02": " "}, "poem", None, None)]
    df = spark.createDataFrame(rows, "id int, dims map<string,string>, kind string, confidence double, claims string")
    got = {r["id"]: r["v"] for r in df.select("id", K.validate_extraction("dims", "kind", "confidence", "claims", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("v")).collect()}
    assert got[1]["valid"] and got[1]["warnings"] == [] and got[1]["answered"] == 5
    assert got[2]["issues"] == ["missing required: q03_key_claims"] and got[2]["warnings"][0] == "low confidence" and got[2]["warnings"][-1] == "few dimensions"
    assert got[3]["issues"] == ["confidence too low"] and "missing recommended: keywords" in got[3]["warnings"]
    assert got[4]["valid"] and got[5]["issues"] == ["missing key claims"]
    assert len(got[6]["issues"]) == 4
    one = lambda t, x: spark.createDataFrame([(t, x)], "t string, x string").select(K.title_containment("t", "x")).first()[0]
    assert one("Deep graph networks here", "on deep GRAPH things") == 0.5 and one("Deep graph", "x") == 1 and one("Untitled", "x") == 1 and one("one two three", None) == 1
    assert one("alpha beta gamma", " " * 1000 + "alpha beta gamma") == 0


def test_api_validates(spark):
    with pytest.raises(api.ToolError, match="VALIDATION_ERROR"):
        api.check_query(" ")
    with pytest.raises(api.ToolError, match="VALIDATION_ERROR"):
        api.check_year(1700)
    assert api.check_chunk_types(["a", "b"], ["b", "a"]) is None
    papers = spark.createDataFrame([("p1", "T", ["c"], "book")], "paper_id string, title string, collections array<string>, item_type string")
    chunks = spark.createDataFrame([(1, "p1", "dim_q02", 2000, "c", [1.0, 0.0])], "chunk_id int, paper_id string, chunk_type string, year int, collection string, embedding array<double>")
    lib = api.Library(spark, papers, chunks, lambda q: [1.0, 0.0])
    assert lib.search("x").first()["title"] == "T"
    assert lib.search_dimension("x", "thesis").count() == 1
    assert lib.search_group("x", "impact").count() == 0
    with pytest.raises(api.ToolError, match="INDEX_NOT_FOUND"):
        lib.full_text("p1")


def test_a_group_of_copies_keeps_its_links(spark, tmp_path):
    """60 copies fill each other's lists of 50 partners; the vector beside them belongs to the cluster."""
    from lumenarc.plans import graph_queries as Q

    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60 + i, [0.6, 0.8]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert S.neighbours(spark.read.parquet(str(tmp_path / "embeddings.parquet")), "vec_id", None, digits=9, least=0.4).where("src = 0").count() == 119
    assert {r["label"] for r in Q.ml_02(spark, str(tmp_path)).collect()} == {0}
