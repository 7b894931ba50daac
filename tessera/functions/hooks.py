"""Places for the caller's own models: embedding, token counting, extraction; each runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So much of a text is embedded.
EMBED_CHARS = 8000


def with_embeddings(rows: DataFrame, column: str, load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], size: int = 64) -> DataFrame:
    """``rows`` with embedding: load() is called once per task and gives a function from texts to vectors, called in batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in batches:
            cut = texts.fillna("").str.slice(0, EMBED_CHARS)
            yield pd.Series([list(map(float, v)) for i in range(0, len(cut), size) for v in embed(cut.iloc[i : i + size].tolist())])

    return rows.withColumn("embedding", run(F.col(column)))


def with_token_counts(rows: DataFrame, column: str, load: Callable[[], Callable[[str], int]]) -> DataFrame:
    """``rows`` with token_count by the caller's tokenizer; the estimate where it gives none."""
    from .text import estimate_tokens

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for texts in batches:
            yield pd.Series([count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    n = run(F.col(column))
    return rows.withColumn("token_count", F.when(n > 0, n).otherwise(estimate_tokens(F.col(column))))


def extracted(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """What the caller's extractor makes of the rows, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = load()
        for b in batches:
            yield extract(b)

    return rows.mapInPandas(run, schema)
