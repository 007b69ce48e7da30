"""Item vectors from texts: hashed TF-IDF of Spark's own library, or any encoder of text batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_tfidf(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(item_id, vector) of unit length; texts without words get zeros.  Null counts as empty."""
    rows = df.select(F.col(key).cast("string").alias("item_id"), F.coalesce(text, F.lit("")).alias("_text"))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+").transform(rows)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    weighed = IDF(inputCol="_tf", outputCol="_idf").fit(counts).transform(counts)
    return Normalizer(inputCol="_idf", outputCol="_unit").transform(weighed).select("item_id", vector_to_array("_unit").alias("vector"))


def encoded(df: DataFrame, key: str, text: str, encoder: Callable[[Sequence[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(item_id, vector) by ``encoder``, which turns a list of texts into rows of numbers, ``batch`` texts at a time."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                rows = np.asarray(encoder(b.column(1).to_pylist()), np.float64)
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["item_id", "vector"])

    return df.select(F.col(key).cast("string").alias("item_id"), F.coalesce(text, F.lit(""))).mapInArrow(run, "item_id string, vector array<double>")
