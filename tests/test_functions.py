import pytest
from pyspark.sql import functions as F

from lumenarc.functions import dims as D
from lumenarc.functions import ids as I
from lumenarc.functions import text as T


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("https://doi.org/10.1/AB", "10.1/ab"), ("doi: 10.2/x", "10.2/x"), ("dx.doi.org/10.3/y", "10.3/y"), ("11.4/z", None), (None, None)])
def test_normalize_doi(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "d string")
    assert df.select(I.normalize_doi("d").alias("r")).first()["r"] == want


@pytest.mark.parametrize(("prose", "want"), [("rated 4", 4), ("3/5", 3), ("an excellent one", 5), ("rigorous", 4), ("very weak", 2), ("fundamentally flawed", 1), ("so so", 3), ("", 0), (None, 0)])
def test_quality_rating(spark, prose, want):
    df = spark.createDataFrame([(prose,)], "d string")
    assert df.select(T.quality_rating("d").alias("r")).first()["r"] == want


def test_title_tokens_and_jaccard(spark):
    df = spark.createDataFrame([("The Été of New Méthods, and more!", "été méthods")], "a string, b string").select(T.title_tokens("a").alias("x"), T.title_tokens("b").alias("y"))
    r = df.select("x", T.jaccard("x", "y").alias("j"), T.containment("y", "x").alias("c"), T.overlap_coefficient("x", "y").alias("o")).first()
    assert sorted(r["x"]) == ["more", "méthods", "été"]
    assert (round(r["j"], 4), r["c"], r["o"]) == (0.6667, 1.0, 1.0)


def test_clean_text(spark):
    raw = "Intro-\nduction to the matter\n  12  \nshort\nThe second  line is long enough\npage 4 of 9\n\n\n\nlast long line here"
    assert one(spark, T.clean_text("t"), t=raw) == "Introduction to the matter\n\nThe second line is long enough\n\nlast long line here"
    assert one(spark, T.clean_text("t", markdown=True), t="| a |\nx") == "| a |\nx"


def test_sections_and_markers(spark):
    body = "Abstract: " + "words here " * 10 + "\n\nIntroduction\nshort"
    assert list(one(spark, T.extract_sections("t"), t=body)) == ["abstract"]
    assert one(spark, T.section_marker_count("t"), t="Methods, methods and Results") == 2


def test_truncation(spark):
    text = "word " * 1000
    cut = one(spark, T.truncate_at_word("t", 10), t=text)
    assert cut == "word word word word word word word word..."
    assert one(spark, T.truncate_middle("t", 400, 50, 50), t=text).count(T.CUT_MARK.strip()) == 2
    assert one(spark, T.truncate_middle("t"), t="short") == "short"


def test_html(spark):
    page = "<html><head><style>x</style></head><body><nav>menu</nav><!-- c --><p>One &amp; two</p><script>var t='</p>'</script><div>Three</div></body></html>"
    assert one(spark, T.html_to_text("t"), t=page).split() == ["One", "&", "two", "Three"]


def test_keyword_context(spark):
    got = one(spark, T.keyword_context("t", "Cat.", 3, 2), t="a cat. b CAT. c cat. d")
    assert [(h["start"], h["end"], h["context"]) for h in got] == [(2, 6, "a cat. b "), (9, 13, " b CAT. c ")]


@pytest.mark.parametrize(("value", "want"), [(" a ", "a"), ("", None), ("null", None), ('["x","x","y"]', "x; y"), ('{"k":1,"l":""}', "k: 1"), ("true", "true")])
def test_normalize_value(spark, value, want):
    assert one(spark, D.normalize_value("v"), v=value) == want


def test_dimension_registry(spark):
    assert len(D.DIMENSIONS) == 40
    assert D.registry(spark).count() == 40
    m = F.create_map(F.lit("q02_thesis"), F.lit("t"), F.lit("odd"), F.lit("x"))
    assert one(spark, D.dimension_value(m, "thesis")) == "t"
    assert one(spark, D.canonical_map(m)) == {"thesis": "t"}
    assert len(one(spark, D.canonical_map(m, fill=True))) == 40


def test_names_and_dates(spark):
    assert one(spark, I.author_string(F.array(F.lit("A"), F.lit("B"), F.lit("C")))) == "A et al."
    assert one(spark, I.author_string(F.lit(None).cast("array<string>"))) == "Unknown"
    assert one(spark, I.year_of(F.lit("May 1987"))) == 1987
    assert one(spark, F.unix_timestamp(I.epoch_time(F.lit(1_600_000_000_000)))) == 1_600_000_000
    assert one(spark, I.parse_time(F.lit("soon"))) is None
    assert one(spark, I.arxiv_id(F.lit("see arXiv:2101.00001v2"))) == "2101.00001"
