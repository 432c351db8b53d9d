"""Append raw triples from a stream to a graph store, one keyed upsert per micro-batch.

Replays are harmless: a batch that is delivered twice writes the same keys and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kilngraph.operators import graph, normalising
from kilngraph.sources.sinks import GraphStore


def append_batch(batch: DataFrame, store: GraphStore, index: DataFrame | None = None) -> None:
    batch = batch.persist()
    try:
        triples = normalising.deduplicate(normalising.normalise(batch, index)).persist()
        store.append(graph.build_nodes(triples), graph.build_edges(triples))
        triples.unpersist()
    finally:
        batch.unpersist()


def append_stream(raw: DataFrame, store: GraphStore, checkpoint: str, index: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Start the query; ``trigger`` is passed on, e.g. availableNow=True."""
    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_batch(batch, store, index))
    return (writer.trigger(**trigger) if trigger else writer).start()
