"""Stateful best triples: any split of the input gives the rows of the batch form, also over a restart."""

import random

import pytest
from pyspark.sql import Row

from kilngraph.operators import normalising
from kilngraph.sources.graph_store import GraphStore
from kilngraph.streaming.best import BestTriple, apply_changes, best_triples

KIND = "seq long, part int, subject string, relation string, object string, year int, confidence double, context string"


def some_triples(n, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        relation = draw.choice(["供水量为", "2020年供水量为", "用水量为"])
        rows.append((i, 0, f"s{draw.randrange(4)}", relation, draw.choice(["1m", "2m", None]), draw.choice([2020, None]), draw.choice([0.5, 0.9, 0.9, None]), f"c{i}"))
    return rows


def run(spark, tmp_path, files, source):
    """Write one more input file per micro-batch, process what is there, and return all updates in order."""
    for name, rows in files:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").json(str(source))
        updates = best_triples(spark.readStream.schema(KIND).json(str(source)))
        query = updates.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        query = query.foreachBatch(lambda batch, n: batch.coalesce(1).write.mode("append").json(str(tmp_path / "out" / f"{name}")))
        query.start().awaitTermination(180)


@pytest.mark.parametrize("cuts", [[60], [1, 20, 39]])
def test_any_split_gives_the_batch_rows(spark, tmp_path, cuts):
    rows = some_triples(60)
    # Out of order: what comes first in the stream need not be first by seq.
    random.Random(1).shuffle(rows)
    parts, at = [], 0
    for i, n in enumerate(cuts):
        parts.append((f"b{i}", rows[at : at + n]))
        at += n
    run(spark, tmp_path, parts, tmp_path / "in")
    last = {}
    for name, _ in parts:
        folder = tmp_path / "out" / name
        found = spark.read.schema(KIND).json(str(folder)).collect() if folder.exists() else []
        for r in found:
            assert last.get((r.subject, r.year, r.object)) != r.seq  # only changed winners come
            last[r.subject, r.year, r.object] = r.seq
    want = normalising.deduplicate(spark.createDataFrame(rows, KIND)).collect()
    assert last == {(r.subject, r.year, r.object): r.seq for r in want}


class Handle:
    """Stands in for the state of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_an_idle_key_is_forgotten():
    handle, processor = Handle(), BestTriple(["seq", "confidence"], None, 50)
    processor.init(handle)
    row = lambda seq, confidence: Row(__dated=0, __confidence=confidence, __seq=-seq, __part=0, seq=seq, confidence=confidence)
    give = lambda *rows: [r.seq for r in processor.handleInputRows("k", iter(rows), handle)]
    assert give(row(5, 0.5), row(3, 0.5), row(4, 0.4)) == [3] and handle.timers == [1050]
    assert give(row(9, 0.5)) == [] and handle.timers == [1050]
    assert give(row(9, 0.6)) == [9]
    assert list(processor.handleExpiredTimer("k", handle, None)) == [] and give(row(7, 0.1)) == [7]


def test_changes_reach_a_graph_store(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a水库", "总库容为", "5亿m³", "", 0.5, "d1"), (2, "a水库", "总库容为", "5亿m³", "", 0.9, "d2")], "seq long, subject string, relation string, object string, context string, confidence double, source_file string")
    store = GraphStore(spark, str(tmp_path / "g"))
    for _ in range(2):
        apply_changes(normalising.deduplicate(normalising.normalise(raw)), store)
    assert store.nodes().count() == 2 and [r.source_doc for r in store.edges().collect()] == ["d2"]
