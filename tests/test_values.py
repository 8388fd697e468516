import json
import random

import pytest

from lumenarc.functions import dims as D


def plain(value):
    """The text of a parsed value, by recursion."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, list):
        return "; ".join(dict.fromkeys(t for t in map(plain, value) if t)) or None
    first = [plain(value[k]) for k in D.TEXT_KEYS if k in value]
    rest = [(k.replace("_", " "), plain(v)) for k, v in value.items() if k not in D.TEXT_KEYS]
    parts = [t for t in first if t] + [f"{k}: {t}" for k, t in rest if t]
    return "; ".join(dict.fromkeys(parts)) or json.dumps(value, ensure_ascii=False, sort_keys=True)


def some_value(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind == 6:
        return [some_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 7:
        return {rng.choice(["a_b", "z", "note", "text", "Key", "value"]) + rng.choice(["", "", "_x"]): some_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return rng.choice([None, "", "  ", "word", "two words ", "null", "[1]", "{x", "12", 'q"u', "ü: ,"]) if kind < 3 else rng.choice([True, False]) if kind == 3 else rng.choice([0, 7, -3, 10**12]) if kind == 4 else rng.choice([0.5, 1.25, -2.0, 1e5])


def test_nested_values_equal_the_recursion(spark):
    rng = random.Random(4)
    values = [v for v in (some_value(rng, 4) for _ in range(1500)) if isinstance(v, (list, dict))]
    values += [{}, [], {"a": None}, {"b": [], "a": ""}, {"a": {"b": {"c": {"note": "deep", "d": ["x", {"e": 1}]}}}}, [[[["x"]]]], [[], [None]]]
    values.append(json.loads('[' * 200 + '"x"' + ']' * 200))
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r["v"] for r in df.select("i", D.normalize_value("v").alias("v")).collect()}
    for i, v in enumerate(values):
        assert got[i] == plain(v), v


@pytest.mark.parametrize(("value", "want"), [("  plain ", "plain"), ("", None), (None, None), ("null", None), ("{not json", "{not json"), ("[1, 2", "[1, 2"), ("12", "12")])
def test_other_texts_stay(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(D.normalize_value("v")).first()[0] == want
