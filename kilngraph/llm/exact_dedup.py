"""Exact deduplication by text digest, with a heavy-hitter split.

A Misra-Gries pass over the digests finds every digest that holds more than 1/k of the rows.  Those candidates are
counted exactly; the verified ones (at most k, so their broadcast is bounded by k rows) are settled map-side.  All other
digests hold at most a k-th of the rows each and go through one ordinary shuffle.

Defined cases: a null text counts as the empty text; a null id ranks below every other id; of rows that repeat the same
id and text exactly one stays; an empty table gives an empty result; further columns are carried by ``deduplicate`` and
ignored by ``assign``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm.removal import without
from kilngraph.llm.storage import discard, materialise

#: Counters of a Misra-Gries summary, hence also the most rows that are ever broadcast.
HEAVY_COUNTERS = 1024


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text with A-Z lower-cased; a null text counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


class MisraGries:
    """Mergeable frequent-items summary with at most ``k`` counters; counts are lower bounds, short by at most n/(k+1)."""

    def __init__(self, k: int):
        self.k = k
        self.counters: dict[bytes, int] = {}

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        for key, n in zip(keys, counts, strict=True):
            self.counters[key] = self.counters.get(key, 0) + n
        if len(self.counters) > self.k:
            cut = sorted(self.counters.values(), reverse=True)[self.k]
            self.counters = {key: n - cut for key, n in self.counters.items() if n > cut}


def _summarise(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(k)
        for batch in batches:
            if "n" in batch.schema.names:
                summary.add(batch.column("digest").to_pylist(), batch.column("n").to_pylist())
            else:
                found = batch.column("digest").value_counts()
                summary.add(found.field(0).to_pylist(), found.field(1).to_pylist())
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(summary.counters), pa.binary()), "n": pa.array(list(summary.counters.values()), pa.int64())})

    return run


def frequent_candidates(digests: DataFrame, k: int = HEAVY_COUNTERS) -> list[bytes]:
    """Every digest with more than 1/(k+1) of the rows is among the at most ``k`` returned; others may be too.

    Summaries are merged in two levels, so no task sees more than about sqrt(partitions) * k counters.
    """
    found = digests.select("digest").mapInArrow(_summarise(k), "digest binary, n long")
    middle = max(1, int(digests.rdd.getNumPartitions() ** 0.5))
    for parts in (middle, 1):
        found = found.repartition(parts).mapInArrow(_summarise(k), "digest binary, n long")
    return [bytes(r.digest) for r in found.collect()]


def _heavy(digests: DataFrame, k: int) -> DataFrame:
    """Verified winners: digest, keep_id, keep_row, group_size of each digest that really has 1/k of the rows or more."""
    spark = digests.sparkSession
    least = max(2, -(-digests.count() // k))
    keys = spark.createDataFrame([(bytearray(d),) for d in frequent_candidates(digests, k)], "digest binary")
    counted = digests.join(F.broadcast(keys), "digest").groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    rows = counted.select("digest", "top.id", "top.row", "group_size").collect()  # k rows at most
    kinds = f"digest binary, keep_id {digests.schema['id'].dataType.simpleString()}, keep_row long, group_size long"
    return spark.createDataFrame([(bytearray(r[0]), *r[1:]) for r in rows], kinds)


def _digest_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document; ``row`` is fixed once written and tells repeated rows apart."""
    rows = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "exact-digests")


def _settle(digests: DataFrame, heavy: DataFrame) -> DataFrame:
    """id, digest, keep_id, group_size, kept for each row of ``digests``."""
    out = ["id", "digest", "keep_id", "group_size", "kept"]
    settled = digests.join(F.broadcast(heavy), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rest = rest.withColumns({"keep_id": F.max("id").over(group), "group_size": F.count("*").over(group), "kept": F.row_number().over(order) == 1})
    return settled.select(out).unionByName(rest.select(out))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY_COUNTERS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and the digest; nothing is dropped."""
    digests = _digest_table(docs, id_col, text_col)
    rows = _settle(digests, _heavy(digests, k))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY_COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; only narrow rows are shuffled, never a text."""
    digests = _digest_table(docs, id_col, text_col)
    settled = _settle(digests, _heavy(digests, k))
    # Rows that repeat an id and a digest can't be told apart by them: one of them stays if any does.
    judged = settled.groupBy("id", F.col("digest").alias("mark")).agg(F.bool_or("kept").alias("stays"), F.count("*").alias("many"))
    judged = materialise(judged.where("not stays or many > 1").select("id", "mark", "stays"), "exact-dropped")
    discard(digests)
    return without(docs, judged, id_col, text_digest(F.col(text_col)))
