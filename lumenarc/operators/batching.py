"""Batch sizes for outside models: choosing one by probes, and calling again in halves when a batch fails."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes to probe and the seconds a batch may take.
SIZES = (8, 16, 32, 64, 128, 256, 512)
TARGET_SECONDS = 75.0


def candidate_sizes(most: int, sizes: tuple[int, ...] = SIZES) -> list[int]:
    """Sizes to probe, in order, up to `most`, which is the last."""
    some = [s for s in sizes if s <= most]
    return some if some and some[-1] == most else [*some, most]


def probe_sizes(texts: list[str], call: Callable[[list[str]], list], target: float = TARGET_SECONDS) -> list[tuple[int, float, bool]]:
    """(size, seconds, ok) upward over the longest texts, until a batch fails or takes too long."""
    longest, out = sorted(texts, key=len, reverse=True), []
    for size in candidate_sizes(min(len(texts), SIZES[-1])) if texts else []:
        began = time.monotonic()
        try:
            call(longest[:size])
            ok = True
        except Exception:  # whatever the model raises
            ok = False
        out.append((size, time.monotonic() - began, ok))
        if not ok or out[-1][1] > target:
            break
    return out


def choose_batch_size(probes: DataFrame, by: str, target: float = TARGET_SECONDS) -> DataFrame:
    """probes (by, size, seconds, ok) -> by, size: the largest good one within the target, else the fastest good one, else 1."""
    ok = F.col("ok")
    return probes.groupBy(by).agg(F.coalesce(F.max(F.when(ok & (F.col("seconds") <= target), F.col("size"))), F.min_by("size", F.when(ok, F.struct("seconds", "size"))), F.lit(1)).alias("size"))


def call_in_halves(texts: list[str], call: Callable[[list[str]], list], retries: int = 3, wait: float = 0.5) -> list:
    """What `call` gives for the texts; a batch that fails `retries` times is called as two halves. A single text that fails raises."""
    if not texts:
        return []
    for attempt in range(retries):
        try:
            return list(call(texts))
        except Exception:  # whatever the model raises
            if attempt + 1 == retries and len(texts) == 1:
                raise
            if attempt + 1 < retries:
                time.sleep(min(wait * 2**attempt, 10.0))
    half = len(texts) // 2
    return call_in_halves(texts[:half], call, retries, wait) + call_in_halves(texts[half:], call, retries, wait)


def embed_batches(rows: DataFrame, text: str, call: Callable[[list[str]], list], size: int, out: str = "embedding", retries: int = 3) -> DataFrame:
    """rows with the model's vectors, `size` texts to a call; null texts are not sent."""

    @F.arrow_udf("array<double>")
    def ask(texts):
        import pyarrow as pa

        given = texts.to_pylist()
        at = [i for i, t in enumerate(given) if t is not None]
        vectors: list = [None] * len(given)
        for lo in range(0, len(at), size):
            part = at[lo : lo + size]
            for i, v in zip(part, call_in_halves([given[i] for i in part], call, retries), strict=True):
                vectors[i] = v
        return pa.array(vectors, pa.list_(pa.float64()))

    return rows.withColumn(out, ask(F.col(text)))
