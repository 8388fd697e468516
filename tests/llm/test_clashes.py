"""Every output name as an extra column of the input: nothing crashes, and results are those without the extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lumenarc.llm import bpe, langid, linecrf, lines, quality, sharding, simhash, suffixes, tokenfiles, toxicity
from lumenarc.llm.decontaminate import contamination

SF = "/root/testdata/sf0.001"
OUTPUTS = (
    "ids decoded n_tokens slot law size text_crc32 n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept clean_text n_lines n_bad_lines kept_words "
    "n_removed start end lang_pred score held_out predicted fingerprint component component_id n_bytes n_spans kept_sha256 distance item_id round_trip leaf root place digest"
).split()


@pytest.fixture(scope="module")
def clash(odd):
    return odd.withColumns({n: F.lit("x") for n in OUTPUTS})


def same(a, b, names):
    rows = lambda df: sorted(map(str, df.select(*names).collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize(
    "report",
    [bpe.round_trip_digest, sharding.shard_documents, quality.quality_report, lines.line_report, tokenfiles.token_file_digest, langid.language_report, simhash.simhash_report, suffixes.repeats_report],
    ids=lambda f: f.__name__,
)
def test_reports(odd, clash, report):
    plain = report(odd)
    same(report(clash), plain, [c for c in plain.columns if c not in ("shard", "slot")])


def test_operators_replace_columns_of_their_outputs(spark, odd, clash):
    coded = bpe.bpe_decode(bpe.bpe_encode(clash), text_col="decoded")
    assert dict(coded.dtypes)["ids"] == "binary"
    same(coded, odd.withColumn("decoded", F.coalesce("text", F.lit(""))), ["doc_id", "decoded"])
    same(quality.apply_quality_rules(clash), quality.apply_quality_rules(odd), ["doc_id", "n_words", "kept", "clean_text"])
    model = langid.train_language_model(odd.where("lang is not null"))
    same(langid.predict_languages(clash, model), langid.predict_languages(odd, model), ["doc_id", "lang_pred"])
    same(lines.dedup_lines(clash, detail=True), lines.dedup_lines(odd, detail=True), ["doc_id", "text", "n_lines", "n_removed"])
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "score": F.lit("y")})
    same(toxicity.toxicity_report(clash, labels), toxicity.toxicity_report(odd, labels), ["doc_id", "score"])
    same(linecrf.quality_class_report(clash, labels), linecrf.quality_class_report(odd, labels), ["doc_id", "score"])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    same(contamination(clash, bench.withColumn("doc_id", F.lit(1))), contamination(odd, bench), ["doc_id", "item_id"])


def test_stages_with_bpe(spark, odd, clash):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns
    done = P.bpe_stage(spark, clash, SF)
    assert done.count() == odd.count() and done.where("not round_trip").count() == 0
