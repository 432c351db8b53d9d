"""Path patterns against paths found one by one."""

import pytest

from kilngraph.operators.patterns import Node, Step, match

NODES = [("r1", "Reservoir", "甲水库", "v"), ("r2", "Reservoir", "乙水库", None), ("v", "River", "黄河", None), ("s", "Station", "甲站", None), ("a", "Annual", "9", "9")]
EDGES = [("r1", "LOCATED", "位于", "v", None), ("r2", "LOCATED", "位于", "v", None), ("s", "LOCATED", "所在河流", "v", None), ("s", None, "径流量", "a", 2020), ("s", None, "径流量", "a", 2021), ("v", "LOOP", "自环", "v", None)]


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.createDataFrame(NODES, "id string, label string, name string, value string")
    edges = spark.createDataFrame([(*e, 0.5) for e in EDGES], "src string, relation_id string, rel string, dst string, year int, confidence double")
    return nodes, edges


def ids(rows, *places):
    return sorted(tuple(r[f"n{p}_id"] for p in places) for r in rows.collect())


def test_filters_and_directions(tables):
    assert ids(match(*tables, [Node(label="Reservoir"), Step(relation_ids=("LOCATED",)), Node(label="River"), Step(back=True), Node(label="Station")]), 0, 2, 4) == [("r1", "v", "s"), ("r2", "v", "s")]
    assert ids(match(*tables, [Node(), Step(contains=("径流", "水位"), years=(2021,)), Node(id="a")]), 0, 2) == [("s", "a")]
    assert ids(match(*tables, [Node(name="黄河"), Step(either=True), Node()]), 2) == [("r1",), ("r2",), ("s",), ("v",)]
    assert ids(match(*tables, [Node(contains="水库", label=("Reservoir", "River"))]), 0) == [("r1",), ("r2",)]
    assert match(*tables, [Node(label="none"), Step(), Node()]).isEmpty() and match(*tables, [Node()]).count() == 5


def test_both_ends_give_the_same_rows(tables):
    one = match(*tables, [Node(), Step(), Node(id="v")])
    two = match(*tables, [Node(id=("v",)), Step(back=True), Node()])
    assert ids(one, 0, 2) == ids(two, 2, 0) == [("r1", "v"), ("r2", "v"), ("s", "v"), ("v", "v")]


def test_repeated_steps_do_not_revisit(tables):
    rows = match(*tables, [Node(id="r1"), Step(either=True, hops=(1, 3)), Node()])
    assert sorted((r.n2_id, r.e1_hops, r.e1_year) for r in rows.collect()) == [("a", 3, 2020), ("a", 3, 2021), ("r2", 2, None), ("s", 2, None), ("v", 1, None)] or sorted((r.n2_id, r.e1_hops) for r in rows.collect()) == [("a", 3), ("a", 3), ("r2", 2), ("s", 2), ("v", 1)]
    assert sorted(r.e1_hops for r in match(*tables, [Node(id="r1"), Step(either=True, hops=(2, 2)), Node()]).collect()) == [2, 2]


def test_what_is_no_path_is_refused(tables):
    for path in ([], [Node(), Step()], [Step()], [Node(), Node(), Node()], [Node(), Step(hops=(0, 2)), Node()], [Node(), Step(hops=(3, 2)), Node()]):
        with pytest.raises(ValueError):
            match(*tables, path)
