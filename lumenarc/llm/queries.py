"""Queries over the driver's tables, one for each operator, and the SQL that some of them equal."""

from __future__ import annotations

import re

from lumenarc.llm.bpe import round_trip_digest
from lumenarc.llm.common import table
from lumenarc.llm.decontaminate import contamination
from lumenarc.llm.langid import language_report
from lumenarc.llm.linecrf import quality_class_report
from lumenarc.llm.lines import line_report
from lumenarc.llm.merkle import manifest_report
from lumenarc.llm.quality import quality_report
from lumenarc.llm.sharding import shard_documents
from lumenarc.llm.simhash import simhash_report
from lumenarc.llm.suffixes import repeats_report
from lumenarc.llm.tokenfiles import token_file_digest
from lumenarc.llm.toxicity import toxicity_report
from lumenarc.llm.whitening import whitening_report


def documents(query):
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_bpe_round_trip": documents(round_trip_digest),
        "op2_hypergeometric_shards": documents(shard_documents),
        "op3_line_quality": documents(quality_report),
        "op4_fuzzy_lines": documents(line_report),
        "op5_token_files": documents(token_file_digest),
        "op6_language": documents(language_report),
        "op7_toxicity": lambda spark, sf_dir: toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op8_simhash_components": documents(simhash_report),
        "op9_suffix_repeats": documents(repeats_report),
        "op10_decontamination": lambda spark, sf_dir: contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op11_whitening": lambda spark, sf_dir: whitening_report(table(spark, sf_dir, "embeddings")),
        "op12_merkle_manifest": documents(manifest_report),
        "op13_quality_classifier": lambda spark, sf_dir: quality_class_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    }


#: crc32 bit by bit, since DuckDB has no such function; every tree level by level.
MERKLE = """
with recursive fields as (
    select row_number() over () as id, doc_id, source, lang, n_chars, text,
        case when list_reduce(
                list_prepend(4294967295::bigint, list_transform(range(0, 8 * length(doc_id::varchar)), lambda i: ((ascii(substr(doc_id::varchar, (i // 8 + 1)::int, 1)) >> (i % 8)::int) & 1)::bigint)),
                lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) & 1 = 1
            then replace(text, chr(10), '') else text end as tampered
    from documents
), hashed as (
    select *, sha256(f(doc_id) || f(source) || f(lang) || f(n_chars) || f(text)) as leaf, sha256(f(doc_id) || f(source) || f(lang) || f(n_chars) || f(tampered)) as other
    from fields
), placed as (
    select id, doc_id, source, leaf, other, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n
    from hashed
), up as (
    select source, 0 as lvl, place, n, leaf as digest from placed
    union all
    select source, lvl + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by place)) from up where n > 1 group by source, lvl, place // 3, n
), tops as (
    select source, digest, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from up where n = 1
), high as (
    select 0 as lvl, place, n, digest from tops
    union all
    select lvl + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by place)) from high where n > 1 group by lvl, place // 3, n
), below as (
    select id, source, 0 as lvl, place, n, other as now, '' as siblings from placed
    union all
    select b.id, b.source, b.lvl + 1, b.place // 3, (b.n + 2) // 3,
        sha256(string_agg(case when u.place = b.place then b.now else u.digest end, '' order by u.place)),
        b.siblings || string_agg(case when u.place = b.place then '' else u.digest end, '' order by u.place)
    from below b join up u on u.source is not distinct from b.source and u.lvl = b.lvl and u.place // 3 = b.place // 3
    where b.n > 1 group by b.id, b.source, b.lvl, b.place, b.n, b.siblings
), above as (
    select b.id, 0 as lvl, t.place, t.n, b.now, b.siblings, t.digest as subroot
    from below b join tops t on t.source is not distinct from b.source where b.n = 1
    union all
    select a.id, a.lvl + 1, a.place // 3, (a.n + 2) // 3,
        sha256(string_agg(case when h.place = a.place then a.now else h.digest end, '' order by h.place)),
        a.siblings || string_agg(case when h.place = a.place then '' else h.digest end, '' order by h.place), a.subroot
    from above a join high h on h.lvl = a.lvl and h.place // 3 = a.place // 3
    where a.n > 1 group by a.id, a.lvl, a.place, a.n, a.siblings, a.subroot
)
select p.doc_id, p.leaf, a.subroot, r.digest as root, sha256(a.siblings) as proof_sha256, a.now as folded_root, a.now = r.digest as verified
from above a join placed p on p.id = a.id cross join (select digest from high where n = 1) r
where a.n = 1
"""


def field_text(sql: str) -> str:
    """f(x) written out: `-` for null, else bytes, colon, value."""
    return re.sub(r"\bf\((\w+)\)", r"coalesce(strlen(\1::varchar)::varchar || ':' || \1::varchar, '-')", sql)


def oracle_sql():
    return {"op12_merkle_manifest": field_text(MERKLE)}
