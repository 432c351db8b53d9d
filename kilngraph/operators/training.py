"""Training examples from texts and triples, and response masks over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.operators.extraction import chat_prompt

MASKED = -100


def training_example(user: Column, triples: Column) -> Column:
    """Chat text whose model turn holds the triples as compact JSON."""
    return F.concat(chat_prompt(user), F.to_json(triples), F.lit(fixed.CHAT_CLOSE))


def response_start(tokens: Column, marker: Column) -> Column:
    """Place (from 0) behind the first run of ``marker`` in ``tokens``, or -1."""
    n, m = F.size(tokens), F.size(marker)
    places = F.when(n >= m, F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda i: F.slice(tokens, i + 1, m) == marker)
    return F.when(F.size(hits) > 0, F.element_at(hits, 1) + m).otherwise(F.lit(-1))


def mask_prompt(rows: DataFrame, tokens_col: str, marker_col: str, out_col: str = "labels") -> DataFrame:
    """Tokens with everything before the response set to -100; without a marker all of it."""
    start = F.col("resp_start")
    masked = F.transform(F.col(tokens_col), lambda t, i: F.when((start < 0) | (i < start), F.lit(MASKED).cast("long")).otherwise(t.cast("long")))
    return rows.withColumn("resp_start", response_start(F.col(tokens_col), F.col(marker_col))).withColumn(out_col, masked)
