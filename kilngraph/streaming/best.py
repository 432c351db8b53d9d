"""The best triple of each (subject, year, object) of an endless stream, kept as state.

The state of a key is the best triple so far; a micro-batch emits the keys whose winner it changed, so the output is a
stream of updates, of which the last one per key is the row of the batch form (``normalising.deduplicate``), however the
input was cut into micro-batches.  A key that gets no triple for ``idle_ms`` is forgotten if that is given, by a timer on
processing time; it then starts anew.

Ties of the preference go to the triple that came first, as a batch goes by ``seq`` and ``part``, which have to be unique.
The state lies in the RocksDB store, so it is bounded by disk and saved with the checkpoint, not by memory.

Defined cases: null years and other null parts of a key are values of their own; a null confidence is below any other;
columns of the input are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from kilngraph.operators.normalising import preference
from kilngraph.sources.graph_store import GraphStore

PROVIDER_KEY, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ("subject", "year", "object")
RANKS = ("__dated", "__confidence", "__seq", "__part")


class BestTriple(StatefulProcessor):
    """Keeps one row per key; ``columns`` are the input's, ``idle_ms`` the time after which a key is forgotten."""

    def __init__(self, columns: list[str], state: StructType, idle_ms: int | None):
        self.columns, self.state, self.idle_ms = columns, state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        had = self.best.get() if self.best.exists() else None
        best = had and Row(*had)
        for row in rows:
            row = tuple(row[c] for c in (*RANKS, *self.columns))
            if best is None or row[: len(RANKS)] > tuple(best)[: len(RANKS)]:
                best = row
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        if had is None or tuple(best)[: len(RANKS)] != tuple(had)[: len(RANKS)]:
            self.best.update(tuple(best))
            yield Row(**dict(zip(self.columns, tuple(best)[len(RANKS) :], strict=True)))

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[Row]:
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def best_triples(triples: DataFrame, idle_ms: int | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """A stream of changed winners of a stream of normalised triples; to be written in update mode."""
    triples.sparkSession.conf.set(PROVIDER_KEY, PROVIDER)
    rank = preference()
    names = [F.col("__rank.dated").alias(RANKS[0]), F.coalesce("__rank.confidence", F.lit(float("-inf"))).alias(RANKS[1]), F.col("__rank.seq").cast("long").alias(RANKS[2]), F.col("__rank.part").cast("long").alias(RANKS[3])]
    rows = triples.withColumn("__rank", rank).select(*triples.columns, *names)
    state = StructType([rows.schema[c] for c in (*RANKS, *triples.columns)])
    for field in state.fields:
        field.nullable = True
    processor = BestTriple(triples.columns, state, idle_ms)
    # A key's parts are compared as text, so that nulls are values.
    keyed = rows.withColumn("__key", F.to_json(F.struct(*key)))
    mode = "ProcessingTime" if idle_ms is not None else "None"
    return keyed.groupBy("__key").transformWithState(processor, triples.schema, outputMode="Update", timeMode=mode)


def apply_changes(batch: DataFrame, store: GraphStore) -> None:
    """Upsert the changed winners of one micro-batch into a graph store; replays change nothing."""
    from kilngraph.operators import graph

    batch = batch.persist()
    try:
        store.append(graph.build_nodes(batch), graph.build_edges(batch))
    finally:
        batch.unpersist()


__all__ = ["BestTriple", "apply_changes", "best_triples"]
