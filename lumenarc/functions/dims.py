"""Dimension profiles: the registry of questions, value resolution, normalization of answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions.text import col

#: The sections of the default profile and their dimensions, in order; aliases are q01 to q40 in this order.
SECTIONS = {
    "research_core": "research_question thesis key_claims evidence limitations",
    "methodology": "paradigm methods data reproducibility framework",
    "context": "traditions key_citations assumptions counterarguments novelty stance",
    "meta": "field audience implications future_work quality contribution source_type other",
    "scholarly": "institutional_context historical_timing paradigm_influence disciplines_bridged cross_domain_insights cultural_scope philosophical_assumptions",
    "impact": "deployment_gap infrastructure_contribution power_dynamics gaps_and_omissions dual_use_concerns emergence_claims remaining_other network_properties policy_recommendations",
}
DIMENSIONS = [(d, s) for s, ds in SECTIONS.items() for d in ds.split()]
CORE = SECTIONS["research_core"].split()
ALIASES = {f"q{i:02d}": d for i, (d, _) in enumerate(DIMENSIONS, 1)} | {f"q{i:02d}_{d}": d for i, (d, _) in enumerate(DIMENSIONS, 1)}


def names_of(identifier: str) -> list[str]:
    """All keys under which an answer may stand, the canonical one first."""
    canonical = ALIASES.get(identifier, identifier)
    alias = [a for a, d in ALIASES.items() if d == canonical]
    return list(dict.fromkeys([identifier, canonical, *alias]))


def dimension_value(dims: Column | str, identifier: str) -> Column:
    """The answer under its id, its canonical name or an alias; null if there is none."""
    return F.coalesce(*[F.try_element_at(col(dims), F.lit(n)) for n in names_of(identifier)])


def canonical_map(dims: Column | str, fill: bool = False) -> Column:
    """Aliases become canonical names, unknown keys go; with fill, missing dimensions are null."""
    alias = F.create_map(*[F.lit(x) for pair in (ALIASES | {d: d for d, _ in DIMENSIONS}).items() for x in pair])
    known = F.map_filter(col(dims), lambda k, v: F.map_contains_key(alias, k))
    renamed = F.transform_keys(known, lambda k, v: F.try_element_at(alias, k))
    if not fill:
        return renamed
    missing = F.map_from_arrays(F.array(*[F.lit(d) for d, _ in DIMENSIONS]), F.array(*[F.lit(None).cast("string") for _ in DIMENSIONS]))
    return F.map_concat(F.map_filter(missing, lambda k, v: ~F.map_contains_key(renamed, k)), renamed)


def registry(spark: SparkSession) -> DataFrame:
    """pos, dimension, section, alias, chunk_type, core: one row for each dimension of the default profile."""
    rows = [(i, d, s, f"q{i:02d}", f"dim_q{i:02d}", d in CORE) for i, (d, s) in enumerate(DIMENSIONS, 1)]
    return spark.createDataFrame(rows, "pos int, dimension string, section string, alias string, chunk_type string, core boolean")


#: Keys whose texts come first, in order.
TEXT_KEYS = "description summary analysis answer text explanation rationale value finding claim recommendation implication note".split()


def nested_text(value) -> str | None:
    """One text of a parsed JSON value, from inside out: in lists and maps the texts of what they hold, texts under TEXT_KEYS first, then `key: text`,
    each once. A map without any text is its own JSON."""
    if value is None or isinstance(value, str):
        return (value or "").strip() or None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        held = [nested_text(v) for v in value]
    elif isinstance(value, dict):
        first = {k: nested_text(value[k]) for k in TEXT_KEYS if k in value}
        rest = ((k, nested_text(v)) for k, v in value.items() if k not in first)
        held = [*first.values(), *(f"{k.replace('_', ' ')}: {t}" for k, t in rest if t)]
    else:
        return str(value)
    text = "; ".join(dict.fromkeys(t for t in held if t))
    return text or (json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None)


def normalize_value(value: Column | str) -> Column:
    """An answer as one text; JSON lists and maps of any depth are folded, other texts trimmed. Blank and null as null.

    Only lists and maps reach Python: neither a Column expression nor SQL can recurse.
    """
    v = F.trim(col(value))
    nested = v.startswith("[") | v.startswith("{")

    @F.arrow_udf("string")
    def fold(texts):
        import pyarrow as pa

        def one(text):
            try:
                return nested_text(json.loads(text)) if text is not None else None
            except (ValueError, RecursionError):
                return text

        return pa.array([one(t.as_py()) for t in texts], pa.string())

    return F.when(nested, fold(F.when(nested, v))).when(v == "null", None).otherwise(F.nullif(v, F.lit("")))
