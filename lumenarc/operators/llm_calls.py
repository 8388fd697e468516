"""Calls of an outside model as a partition map; the default stands in without a network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def echo(prompt: str) -> str:
    return f"echo: {prompt}"


def call_model(rows: DataFrame, prompt: str, reply: str, model: Callable[[str], str] = echo) -> DataFrame:
    """rows with the model's reply; a null prompt is not sent."""

    @F.arrow_udf("string")
    def ask(prompts):
        import pyarrow as pa

        return pa.array([None if p.as_py() is None else model(p.as_py()) for p in prompts], pa.string())

    return rows.withColumn(reply, ask(F.col(prompt)))


def embed(rows: DataFrame, text: str, out: str = "embedding", width: int = 384) -> DataFrame:
    """Hashed term-frequency vectors of unit length: the embedding used where no model is given."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    tf = HashingTF(numFeatures=width, inputCol="__t", outputCol="__v").transform(rows.withColumn("__t", tokens))
    return Normalizer(inputCol="__v", outputCol="__u").transform(tf).withColumn(out, vector_to_array("__u")).drop("__t", "__v", "__u")
