import json

import pytest

from lumenarc.operators import batching as B
from lumenarc.operators import corpus as C
from lumenarc.operators import graph as G
from lumenarc.sources import lookup as K
from lumenarc.sources import store as ST


def test_sizes_to_probe():
    assert B.candidate_sizes(40) == [8, 16, 32, 40]
    assert B.candidate_sizes(32) == [8, 16, 32]
    assert B.candidate_sizes(3) == [3]


def test_probing_ends_with_the_first_failure():
    def call(texts):
        if len(texts) > 16:
            raise ValueError
        return texts

    assert [(n, ok) for n, _, ok in B.probe_sizes(["x"] * 100, call)] == [(8, True), (16, True), (32, False)]
    assert B.probe_sizes([], call) == []


def test_choice_of_a_size(spark):
    rows = [("a", 8, 1.0, True), ("a", 16, 70.0, True), ("a", 32, 90.0, True), ("b", 8, 100.0, True), ("b", 16, 80.0, True), ("c", 8, 1.0, False)]
    got = B.choose_batch_size(spark.createDataFrame(rows, "backend string, size int, seconds double, ok boolean"), "backend")
    assert {r["backend"]: r["size"] for r in got.collect()} == {"a": 16, "b": 16, "c": 1}


def test_failing_batches_are_halved(spark):
    calls = []

    def call(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise ValueError
        return [[float(len(t))] for t in texts]

    assert B.call_in_halves(["a", "bb", "ccc", "dd", "e"], call, retries=2, wait=0) == [[1.0], [2.0], [3.0], [2.0], [1.0]]
    assert calls == [5, 5, 2, 3, 3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        B.call_in_halves(["a"], lambda texts: 1 / 0, retries=2, wait=0)
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
    assert [r["embedding"] for r in B.embed_batches(df, "t", lambda ts: [[float(len(t))] for t in ts], 2).orderBy("id").collect()] == [[2.0], None, [0.0]]


def test_services_share_their_fields(spark):
    cases = {
        "crossref": {"DOI": "10.1/x", "title": ["A title"], "author": [{"given": "Ann", "family": "Lee"}], "container-title": ["J"], "page": "1-2", "published-online": {"date-parts": [[2001, 5]]}},
        "openalex": {"doi": "https://doi.org/10.1/x", "display_name": "A title", "authorships": [{"author": {"display_name": "Ann Lee"}}], "primary_location": {"source": {"display_name": "J"}}, "biblio": {"first_page": "1", "last_page": "2"}, "publication_year": 2001},
        "semantic_scholar": {"externalIds": {"DOI": "10.1/x"}, "title": "A title", "authors": [{"name": "Ann Lee"}], "venue": "J", "year": 2001},
        "openlibrary": {"title": "A title", "publishers": ["P"], "publish_date": "May 2001"},
    }
    for name, work in cases.items():
        df = spark.createDataFrame([(json.dumps(work),), (None,), ("{bad",)], "json string")
        got = [r["w"] for r in df.select(K.PARSERS[name]("json").alias("w")).collect()]
        assert (got[0]["title"], got[0]["year"]) == ("A title", 2001)
        if name != "openlibrary":
            assert (got[0]["doi"], got[0]["journal"], [tuple(a) for a in got[0]["authors"]]) == ("10.1/x", "J", [("Ann", "Lee")])
        assert got[1]["title"] is None and got[2]["title"] is None


def test_fetching(spark):
    def fetch(url):
        if url == "bad":
            raise OSError
        return f"[{url}]"

    df = spark.createDataFrame([("a",), (None,), ("bad",)], "url string").coalesce(1)
    assert [r["json"] for r in K.fetch_json(df, "url", fetch, seconds=0.0).collect()] == ["[a]", None, None]


def test_json_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    assert ST.write_json(spark, path, {"x": 1})
    assert ST.write_json(spark, path, {"x": [2, "é"]})
    assert json.loads((tmp_path / "a" / "b.json").read_text()) == {"x": [2, "é"]}
    assert [f.name for f in (tmp_path / "a").iterdir() if not f.name.endswith(".crc")] == ["b.json"]


def test_snapshot_brings_artifacts_back(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{root}/one")
    held = ST.Snapshot(spark, root, ["one", "two"])
    spark.range(9).write.mode("overwrite").parquet(f"{root}/one")
    spark.range(1).write.parquet(f"{root}/two")
    held.restore()
    held.drop()
    assert spark.read.parquet(f"{root}/one").count() == 3
    assert sorted(f.name for f in tmp_path.iterdir()) == ["one"]


def test_part_of_by_its_three_rules(spark):
    rows = [
        (0, "book", "The art of war", "Sun", "book", "K", None), (1, "sec", "On terrain", None, "bookSection", "K", None), (2, "ch", "The art of war, Chapter 2", "sun", "document", None, None),
        (3, "r1", "Week one", None, "document", None, "t1"), (4, "r2", "Week One", None, "document", None, "t2 "), (5, "r3", "week one!", None, "document", None, None),
        (6, "u1", "Same", None, "document", None, "t"), (7, "u2", "Same", None, "document", None, "t"), (8, "u3", "Same", None, "document", None, "t"),
    ]
    df = spark.createDataFrame(rows, "pos int, paper_id string, title string, author_string string, item_type string, library_key string, thesis string")
    got = {tuple(r) for r in G.part_of(df).collect()}
    assert got == {("sec", "book", "chapter_in_book"), ("ch", "book", "chapter_in_book"), *((f"r{i}", "virtual_collection_week_one", "reading_in_syllabus") for i in (1, 2, 3))}


def test_coverage_asks_all_tokens(spark):
    found = spark.createDataFrame([("n1", ["a", "b", "a"]), ("n2", ["a"]), ("n3", ["z"]), ("n4", [])], "norm string, tokens array<string>")
    index = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 3)], "token string, paper_id int")
    assert {r["norm"]: r["covered"] for r in C.direction_coverage(found, index).collect()} == {"n1": 1, "n2": 2, "n3": 0, "n4": 0}
