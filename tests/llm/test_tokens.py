import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenarc.llm import bpe
from lumenarc.llm import tokenfiles as tf

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t'aàésltrd.,!12٣中😀-_ \x1c\x85<|>e"), max_size=40) | st.text(max_size=60))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    for t in (text, text + "<|endoftext|>" + text):
        for encoder in (bpe.vocabulary_encoder(PATH), tf.library_encoder(PATH)):
            assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == expected(t)


def test_words_merged_exactly_equal_words_speculated():
    v = bpe.Vocabulary(PATH)
    words = [w.encode() for w in ("tionthering", " ouandnt", "xxxxxxxxxxxxxxxx", "aaaaaaa", "é" * 30, " antidisestablishmentarianism")]
    assert v.encode_words(words) == [v.merge(w) for w in words]
    assert v.sound.all()


def test_pairs_are_compatible_exactly_when_merging_keeps_them():
    v = bpe.Vocabulary(PATH)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, v.n, 400), rng.integers(0, v.n, 400)
    as_bytes = {i: t for t, i in v.tokens.items()}
    held = v.compatible(a, b)
    assert [v.merge(as_bytes[x] + as_bytes[y]) == [x, y] for x, y in zip(a, b, strict=True)] == held.tolist()


def test_round_trip_of_documents(documents):
    rows = bpe.round_trip_digest(documents).join(documents.select("doc_id", "text"), "doc_id").collect()
    import hashlib

    assert len(rows) == documents.count()
    for r in rows:
        ids = expected(r["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_rows_round_trip(odd, empty):
    got = bpe.bpe_decode(bpe.bpe_encode(odd)).collect()
    assert len(got) == odd.count()
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    assert bpe.round_trip_digest(empty).count() == 0


def test_token_files_hold_all_ids_in_order(spark, documents):
    folder, manifest = tf.write_token_files(documents.select("doc_id", "text"), file_docs=40)
    assert manifest.count() > 2
    got = [tuple(r) for r in tf.read_token_files(spark, folder, manifest).orderBy("doc_id").collect()]
    start = 0
    for (doc_id, at, n, ids), r in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        want = [*expected(r["text"]), tf.END_ID]
        assert (doc_id, at, n) == (r["doc_id"], start, len(want))
        assert np.frombuffer(ids, "<u4").tolist() == want
        start += n


def test_a_short_document_is_read_alone(spark, documents):
    folder, manifest = tf.write_token_files(documents.select("doc_id", "text"), file_docs=50)
    from pyarrow import fs as afs

    fs, where = tf.filesystem(folder)
    (name,) = [f.path for f in fs.get_file_info(afs.FileSelector(where)) if f.path.endswith(".dict")]
    with fs.open_input_stream(name) as f:
        dictionary = f.read()
    uri = manifest.orderBy("bucket").first()["uri"]
    file = tf.TokenFile(uri, dictionary)
    first = documents.orderBy("doc_id").first()
    assert file.keys[0] == [first["doc_id"]]
    assert file.ids(0).tolist() == [*expected(first["text"]), tf.END_ID]
    try:
        tf.TokenFile(uri, dictionary + b"x")
        raise AssertionError("another dictionary was taken")
    except ValueError:
        pass


def test_token_files_of_odd_rows(spark, odd, empty):
    got = tf.token_file_digest(odd).collect()
    assert len(got) == odd.count()
    assert sorted(r["start"] for r in got)[0] == 0
    nulls = [r for r in got if r["doc_id"] is None]
    assert nulls[0]["start"] == 0
    assert nulls[0]["n_tokens"] == 1
    assert nulls[0]["ids_crc32"] == zlib.crc32(b"\0\0\0\0")
    total = sum(r["n_tokens"] for r in got)
    assert max(r["start"] + r["n_tokens"] for r in got) == total
    assert tf.token_file_digest(empty).count() == 0
    assert odd.where(F.col("doc_id").isNull()).count() == 1
