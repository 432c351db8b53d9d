"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is handed out in equal blocks of words.  Blocks go to sources by the highest quotients target / (2 s + 1), then
each source's blocks go to its shards by the same rule with the shards' sizes as votes.  Inside a shard the documents lie
on a ring in seeded order; the shard's blocks are a run on that ring from a seeded block, so whole documents are taken
except at the two ends of a run.

Only per-source and per-shard summaries are ever gathered in one task; documents are ranked within shards of bounded
size, so a source with a third of all rows is spread over many shards.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own and comes last; rows that
repeat are separate rows; an empty table, or one without words, takes nothing; further columns are carried by ``blend``.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm.storage import fresh, materialise

WORD = "[^\\x20\\x09-\\x0D]++"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all words, and the most a source may be repeated.
MIX_SHARE, MOST_PASSES = 1.5, 2
#: Largest block, and the least number of blocks in the smallest positive target.
BLOCK_WORDS, LEAST_BLOCKS = 512, 200
#: Words of a shard, on average.
SHARD_WORDS = 1_000_000
SEED = 20_240_229
#: A source table of at most so many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def apportion(votes: Sequence[float], seats: int) -> np.ndarray:
    """Sainte-Lague seats; equal quotients go to the earlier entry.

    Rounding votes / divisor is itself a Sainte-Lague outcome for its own total, so it is a start from which only a few
    highest (or lowest) quotients are added (or taken back).
    """
    v = np.asarray(votes, dtype=float)
    if not len(v) or v.sum() <= 0 or seats <= 0:
        return np.zeros(len(v), dtype=np.int64)
    got = np.floor(v * (seats / v.sum()) + 0.5).astype(np.int64)
    short = seats - int(got.sum())
    if short > 0:
        queue = [(-v[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(v > 0)]
        heapq.heapify(queue)
        for _ in range(short):
            _, i = queue[0]
            got[i] += 1
            heapq.heapreplace(queue, (-v[i] / (2 * got[i] + 1), i))
    elif short < 0:
        queue = [(v[i] / (2 * got[i] - 1), -i) for i in np.flatnonzero(got > 0)]
        heapq.heapify(queue)
        for _ in range(-short):
            _, i = heapq.heappop(queue)
            got[-i] -= 1
            if got[-i] > 0:
                heapq.heappush(queue, (v[-i] / (2 * got[-i] - 1), i))
    return got


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST_PASSES) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut off is shared again by weight."""
    size, w = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    cap, out, open_ = most * size, np.zeros(len(size)), np.ones(len(size), dtype=bool)
    while open_.any():
        out[open_] = (total - out[~open_].sum()) * w[open_] / w[open_].sum()
        above = open_ & (out > cap)
        if not above.any():
            break
        out[above], open_ = cap[above], open_ & ~above
    return out


def plan_sources(sources: pd.DataFrame, weights=WEIGHTS, share=MIX_SHARE, most=MOST_PASSES, block_words=BLOCK_WORDS) -> pd.DataFrame:
    """Targets and block quotas; ``sources`` comes in order, one row per source."""
    w = np.resize(np.asarray(weights, dtype=float), len(sources))
    total = share * float(sources.source_size.sum())
    goal = targets(sources.source_size, w, total, most)
    positive = goal[goal > 0]
    block = int(max(1, min(block_words, positive.min() // LEAST_BLOCKS))) if len(positive) else 1
    return sources.assign(target=goal, block=block, seats=apportion(goal, int(round(goal.sum() / block))))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = MIX_SHARE, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, passes and the run of extra words.

    ``passes`` counts how often the whole document is taken; ``extra`` lists [from, to) word ranges taken once more.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    kinds = f"source {sized.schema['source'].dataType.simpleString()}, source_size long, rank int"

    def plan(sources: pd.DataFrame) -> pd.DataFrame:
        return plan_sources(sources.sort_values("rank"), weights, share, most, block_words)

    planned = per_source.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda g: plan(g.drop(columns="all")), f"{kinds}, target double, block long, seats long")
    planned = materialise(planned.withColumn("shards", F.ceil(F.greatest(F.lit(1), F.col("source_size")) / F.lit(shard_words))), "mix-sources")
    few = planned.count() <= BROADCAST_SOURCES
    side = planned.withColumnRenamed("source", "planned_source")
    side = F.broadcast(side) if few else side
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("planned_source")), "left").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")))

    filled = rows.where("size > 0").groupBy("rank", "shard", "block", "seats").agg(F.sum("size").alias("shard_size"))

    def deal(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        return shards[["rank", "shard", "shard_size"]].assign(quota=apportion(shards.shard_size, int(shards.seats.iloc[0])))

    quotas = filled.groupBy("rank").applyInPandas(deal, "rank int, shard long, shard_size long, quota long")
    quotas = materialise(quotas, "mix-quotas").withColumnsRenamed({"rank": "q_rank", "shard": "q_shard"})

    ring = Window.partitionBy("rank", "shard").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.where("size > 0").withColumn("at", F.coalesce(F.sum("size").over(ring), F.lit(0)))
    same = (F.col("rank") == F.col("q_rank")) & (F.col("shard") == F.col("q_shard"))
    placed = placed.join(quotas, same, "left").drop("q_rank", "q_shard")
    blocks = F.ceil(F.col("shard_size") / F.col("block"))
    placed = placed.withColumn("blocks", blocks).withColumn("quota", F.least("quota", F.col("blocks") * most))
    placed = placed.withColumns({"passes": F.floor(F.col("quota") / F.col("blocks")), "run": F.col("quota") % F.col("blocks"), "first": F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), F.col("blocks"))})
    # The run covers blocks [first, first + run) on the ring: one interval, and a second one where it wraps.
    low, high = F.col("first") * F.col("block"), (F.col("first") + F.col("run")) * F.col("block")
    end = F.col("at") + F.col("size")
    turn = F.col("blocks") * F.col("block")
    spans = [F.struct(F.greatest(a, "at").alias("from"), F.least(b, end).alias("to")) for a, b in ((low, F.least(high, turn)), (F.lit(0).cast("long"), high - turn))]
    spans = F.filter(F.array(*[F.struct((s["from"] - F.col("at")).alias("from"), (s["to"] - F.col("at")).alias("to")) for s in spans]), lambda s: s["from"] < s["to"])
    placed = placed.withColumn("extra", spans)
    more = F.aggregate("extra", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + more)
    none = rows.where("size = 0").withColumns({"passes": F.lit(0).cast("long"), "extra": F.array().cast("array<struct<from:bigint,to:bigint>>"), "taken": F.lit(0).cast("long")})
    out = ["id", "key", "size", "source_size", "target", "taken", "passes", "extra"]
    return placed.select(out).unionByName(none.select(out)).withColumnRenamed("id", id_col)


def blend(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes words from, all columns, with what ``mixture`` says of them.

    Clashing names get a trailing underscore on the added column.  Rows that repeat id and text exactly share out what the
    mix takes of them: as many rows get each amount as the plan has.
    """
    names = docs.columns
    key, what, place = (fresh(names, x) for x in ("__mix_key", "__mix", "__place"))
    seed = options.get("seed", SEED)
    extra = ["size", "source_size", "target", "taken", "passes", "extra"]
    got = mixture(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, **options).where("taken > 0")
    # Repeated rows have few different amounts, so a list of amounts with their counts is short.
    got = got.groupBy("key", *extra).agg(F.count("*").alias("n"))
    got = got.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("taken", "passes", "size", "source_size", "target", "extra", "n")), asc=False).alias(what))
    got = materialise(got, "mix-taken")
    rows = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).join(got, [key])
    if got.where((F.size(what) > 1) | (F.col(what)[0]["n"] > 1)).isEmpty():
        rows = rows.withColumn(what, F.col(what)[0])
    else:
        rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))))
        begins = F.transform(what, lambda _, i: F.aggregate(F.slice(F.col(what), F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["n"]))
        mine = F.filter(F.zip_with(what, begins, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), lambda z: (z["b"] < F.col(place)) & (F.col(place) <= z["b"] + z["x"]["n"]))
        rows = rows.withColumn(what, F.get(mine, F.lit(0))["x"]).where(F.col(what).isNotNull())
    return rows.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"{what}.{c}").alias(fresh(names, c)) for c in extra])
