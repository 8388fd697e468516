from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import merkle as M
from lumenarc.llm.queries import oracle_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def manifest(rows, fanout=3):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, digest(*[field(r[c]) for c in M.FIELDS]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(groups[g], key=lambda x: x[:3]) for g in names}
    trees = {g: tree([x[2] for x in members[g]], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for g in names:
        for i, (_, _, leaf, r) in enumerate(members[g]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now, siblings = digest(*[field(text if c == "text" else r[c]) for c in M.FIELDS]), []
            for levels, place in ((trees[g], i), (top, names.index(g))):
                for level in levels[:-1]:
                    first = place // fanout * fanout
                    run = level[first : first + fanout]
                    siblings += [x for k, x in enumerate(run) if first + k != place]
                    now = digest(*[now if first + k == place else x for k, x in enumerate(run)])
                    place //= fanout
            out.append((r["doc_id"], leaf, trees[g][-1][0], top[-1][0], digest(*siblings), now, now == top[-1][0]))
    return order(out)


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


def as_key(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("height", [1, 2, 7])
@pytest.mark.parametrize("fanout", [2, 3])
def test_blocks_of_any_height_give_the_same_proofs(spark, documents, height, fanout):
    at = {c: F.col(c) for c in M.FIELDS}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = M.leaf(*(at | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    got = M.build_manifest(documents.repartition(5), M.leaf(*at.values()), F.col("source"), {"doc_id": F.col("doc_id")}, F.when(even, changed), height, fanout)
    assert as_key(got.collect()) == as_key(manifest(documents.collect(), fanout))


def test_report_equals_the_plain_tree_and_the_sql(spark, documents):
    got = M.manifest_report(documents)
    assert as_key(got.collect()) == as_key(manifest(documents.collect()))
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    assert as_key(con.execute(oracle_sql()["op12_merkle_manifest"]).fetchall()) == as_key(got.collect())


def test_odd_rows(spark, odd, empty):
    got = M.manifest_report(odd)
    assert as_key(got.collect()) == as_key(manifest(odd.collect()))
    assert M.manifest_report(empty).collect() == []
    assert M.manifest_report(empty).dtypes == got.dtypes


def test_equal_rows_and_one_large_group_spread(spark):
    rows = [(5, "a\nb", "en", "hot", 3)] * 300 + [(i, f"t{i}\n", None, "hot" if i % 3 else f"s{i}", 1) for i in range(90)] + [(None, None, None, None, None)] * 5
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    at = {c: F.col(c) for c in M.FIELDS}
    got = M.build_manifest(df, M.leaf(*at.values()), F.col("source"), {"doc_id": F.col("doc_id")}, height=2).collect()
    want = manifest(df.collect())
    assert all(r["verified"] for r in got)
    assert sorted(r["proof_sha256"] for r in got) == sorted(r[4] for r in want)


def test_a_lone_row_is_its_own_root(spark):
    one = spark.createDataFrame([(1, "x\ny", "en", "s", 3)], SCHEMA)
    (r,) = M.manifest_report(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == digest()
    assert r["verified"] is (crc32(b"1") % 2 == 1)


def test_clashing_columns_play_no_part(spark):
    rows = [(1, "x", "en", "s", 3, "a", "b"), (2, "y", "en", "t", 3, "c", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", grp string, place string")
    assert as_key(M.manifest_report(df).collect()) == as_key(M.manifest_report(df.drop("grp", "place")).collect())
