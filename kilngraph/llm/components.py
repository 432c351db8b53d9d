"""Connected components by alternating large-star and small-star steps; edges stay in tables, never on the driver.

Defined cases: an edge from a node to itself gives no row; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm.storage import discard, materialise

MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u > v).  Large: neighbours above u hang on u's smallest neighbour; small: those below do."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    joined = sides.join(least, F.col("u") == F.col("of"))
    moved = joined.where("v > u") if large else joined.where("v <> m")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge; the label is the smallest node of its component."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = materialise(pairs, "edges")
    before = _state(pairs)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        last, pairs = pairs, materialise(_star(_star(pairs, True), False), "edges")
        discard(last)
        now = _state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    top = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(top)
