"""The graph store: what a write touches, what a lookup reads, constraints, rival writers, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from kilngraph.operators import graph
from kilngraph.sources.graph_store import DuplicateKey, GraphStore

NODE, EDGE = "id string, name string, label string, value string", "src string, rel string, dst string, year int, confidence double, source_doc string"


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE)


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture
def store(spark, tmp_path):
    out = GraphStore(spark, str(tmp_path / "g"))
    out.write_full(nodes(spark, [(f"n{i}", f"name {i % 150}", "L", str(i)) for i in range(300)]), edges(spark, [(f"n{i}", "r", f"n{(i * 7) % 300}", i % 3 or None, 0.5, f"doc{i % 20}") for i in range(300)]))
    return out


def files(root):
    return {str(p.relative_to(root)) for p in (root / "data").rglob("*.parquet")}


def test_an_append_writes_its_keys_and_nothing_else(spark, tmp_path, store):
    before = files(tmp_path / "g")
    stamps = {f: (tmp_path / "g" / f).stat().st_mtime_ns for f in before}
    store.append(nodes(spark, [("n5", None, None, "new"), ("x", "added", "M", "1")]), edges(spark, [("n5", "r", "x", 1, 0.9, "doc3"), ("n5", "r", "gone", 1, 0.9, "doc3"), ("n1", "r", "n7", 1, None, "doc1")]))
    added = files(tmp_path / "g") - before
    assert before <= files(tmp_path / "g") and all((tmp_path / "g" / f).stat().st_mtime_ns == t for f, t in stamps.items())
    written = {f.split("/")[-2] for f in added if "/nodes/" in f}
    assert len(written) == len({b for b in store._buckets_of(["n5", "x"], store.snapshot())})
    got = {r.id: r for r in store.nodes().collect()}
    assert len(got) == 301 and (got["n5"].name, got["n5"].value, got["n6"].value, got["x"].name) == ("name 5", "new", "6", "added")
    mine = {(r.src, r.rel, r.dst, r.year): r.confidence for r in store.edges().collect()}
    assert len(mine) == 301 and mine["n5", "r", "x", 1] == 0.9 and mine["n1", "r", "n7", 1] is None and ("n5", "r", "gone", 1) not in mine


def test_same_rows_as_a_merge_of_whole_tables(spark, store):
    old_nodes, old_edges = store.nodes().collect(), store.edges().collect()
    want_nodes, want_edges = nodes(spark, [tuple(r[c] for c in ("id", "name", "label", "value")) for r in old_nodes]), edges(spark, [tuple(r[c] for c in ("src", "rel", "dst", "year", "confidence", "source_doc")) for r in old_edges])
    for turn in range(4):
        new_nodes = nodes(spark, [(f"n{i}", None if i % 2 else f"t{turn}", None, f"v{turn}") for i in range(turn, 400, 11)])
        new_edges = edges(spark, [(f"n{i}", "r", f"n{(i * 7) % 300}", i % 3 or None, float(turn), None) for i in range(turn, 390, 13)])
        store.append(new_nodes, new_edges)
        want_nodes = graph.upsert_nodes(want_nodes, new_nodes)
        want_edges = graph.upsert_edges(want_edges, new_edges, want_nodes)
        store.append(new_nodes, new_edges)  # a replay
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(store.nodes(), want_nodes) and same(store.edges(), want_edges)
    rewritten = store.compact()
    assert rewritten and same(store.nodes(), want_nodes) and same(store.edges(), want_edges)
    assert all(len(f) == 1 for t in store.snapshot()["live"].values() for f in t.values())


def test_only_crowded_buckets_are_compacted(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), most_changes=2)
    store.write_full(nodes(spark, [(f"n{i}", "n", "L", "0") for i in range(200)]), edges(spark, []))
    for turn in range(4):
        store.append(nodes(spark, [("n1", None, None, str(turn))]), edges(spark, []))
    live = store.snapshot()["live"]["nodes"]
    bucket = store._buckets_of(["n1"], store.snapshot())[0]
    assert len(live[bucket]) <= 3 and all(len(f) == 1 for b, f in live.items() if b != bucket)
    base = {f.split("/")[1] for b, fs in live.items() if b != bucket for f in fs}
    assert len(base) == 1 and store.nodes_with(["n1"]).first().value == "3"


def test_lookups_read_the_files_concerned(spark, tmp_path, store):
    read = lambda df: {f.split("/")[-2] for f in df.inputFiles()}
    now = store.snapshot()
    one = store.nodes_with(["n17"])
    assert one.first().name == "name 17" and read(one) == {f"bucket={b}" for b in store._buckets_of(["n17"], now)}
    assert len(read(store.edges_from(["n17"]))) == 1 and [r.dst for r in store.edges_from(["n17"]).collect()] == ["n119"]
    named = store.nodes_named("name 17")
    assert {r.id for r in named.collect()} == {"n17", "n167"} and len(read(named)) <= 2
    found = store.edges_of_document("doc4")
    want = {r.src for r in store.edges().where("source_doc = 'doc4'").collect()}
    assert {r.src for r in found.collect()} == want and read(found) == {f"bucket={b}" for b in store._buckets_of(want, now)} < read(store.edges())
    hit = spark.createDataFrame([("n119",)], "hit string")
    touching = store.edges_touching(hit)
    assert {(r.src, r.dst) for r in touching.where("src = 'n119' or dst = 'n119'").collect()} == {(r.src, r.dst) for r in store.edges().where("src = 'n119' or dst = 'n119'").collect()}
    assert len(read(touching)) <= 2 < len(read(store.edges())) and [r.id for r in store.nodes_among(hit).collect()] == ["n119"]
    near_nodes, near_edges = store.around(["n17"])
    assert {r.id for r in near_nodes.collect()} == {"n17", "n119"} and near_edges.count() == 1
    assert store.nodes_named("nobody").isEmpty() and store.edges_of_document("none").isEmpty() and store.nodes_with(["none"]).isEmpty()
    # An index entry that a later write has made stale finds nothing that is no longer so.
    store.append(nodes(spark, [("n17", "renamed", None, None)]), edges(spark, [("n17", "r", "n119", 2, 0.1, "doc99")]))
    assert {r.id for r in store.nodes_named("name 17").collect()} == {"n167"} and store.nodes_named("renamed").count() == 1
    assert store.edges_of_document("doc99").count() == 1 and not store.edges_of_document("doc17").where("src = 'n17'").count()


def test_a_duplicate_key_fails_the_commit(spark, tmp_path, store):
    number, before = store.generation(), store.nodes().count()
    with pytest.raises(DuplicateKey, match="twice"):
        store.append(nodes(spark, [("twice", "a", "L", "1"), ("twice", "b", "L", "2")]), edges(spark, []))
    with pytest.raises(DuplicateKey):
        store.write_full(nodes(spark, [("a", "a", "L", "1")]), edges(spark, [("a", "r", "a", None, 1.0, "d")] * 2))
    assert store.generation() == number and store.nodes().count() == before


def test_rival_writers_lose_nothing(spark, tmp_path, store):
    errors = []

    def write(k):
        try:
            for turn in range(2):
                GraphStore(spark, str(tmp_path / "g")).append(nodes(spark, [(f"w{k}-{turn}-{i}", "n", "L", "v") for i in range(20)]), edges(spark, [(f"w{k}-{turn}-0", "r", "n1", None, 1.0, f"by{k}")]))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and store.nodes().count() == 300 + 3 * 2 * 20 and store.edges().count() == 300 + 6
    assert store.generation() >= 6
    # A commit of a number that exists is refused.
    assert not store._claim(store.generation(), "x")


def test_compaction_beside_a_rival_append(spark, store):
    for turn in range(3):
        store.append(nodes(spark, [("n1", None, None, f"t{turn}")]), edges(spark, []))
    commit, once = store._commit, []

    def late(change):
        if not once:
            once.append(1)
            GraphStore(store.spark, store.root).append(nodes(spark, [("n1", None, None, "rival")]), edges(spark, []))
        return commit(change)

    store._commit = late
    store.compact()
    assert {r.id: r.value for r in GraphStore(spark, store.root).nodes().collect()}["n1"] == "rival"


def test_vacuum_and_empty_store(spark, tmp_path, store):
    store.append(nodes(spark, [("n1", None, None, "x")]), edges(spark, []))
    store.write_full(nodes(spark, [("only", "n", "L", None)]), edges(spark, []))
    rows = store.nodes()
    store.vacuum(keep=1)
    assert rows.count() == 1 and store.snapshot()["live"]["edges"] == {} and len(list((tmp_path / "g/data").glob("*.json"))) == 1
    assert store.edges().isEmpty() and store.edges().columns == [x.split()[0] for x in EDGE.split(", ")]
    empty = GraphStore(spark, str(tmp_path / "none"))
    assert empty.generation() is None
    with pytest.raises(FileNotFoundError):
        empty.nodes()
    empty.append(nodes(spark, [("a", "n", "L", None), (None, "n", "L", None)]), edges(spark, [("a", "r", "a", None, 1.0, None), ("a", "r", "b", None, 1.0, None)]))
    assert empty.nodes().count() == 1 and empty.edges().select(F.count("*").alias("n")).first().n == 1
