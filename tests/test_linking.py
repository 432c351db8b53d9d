"""Alias linking: the eight published cases, and precedence."""

import pytest

from kilngraph.operators import linking

ALIASES = [
    ("reservoirs", "龙羊峡水库", "龙羊峡", 0), ("reservoirs", "龙羊峡水库", "龙库", 0), ("reservoirs", "三门峡水库", "三门峡", 2),
    ("hydrological_stations", "兰州水文站", "兰州站", 0), ("hydrological_stations", "三门峡水文站", "三门峡", 1),
    ("water_resource_zones", "龙羊峡以上", "龙库以上", 0), ("provinces", "甘肃省", "甘肃", 0), ("provinces", "青海省", "青", 1), ("rivers", "黄河", "黄河干流", 0),
    ("hydropower_stations", "玛尔挡水电站", "玛尔挡", 0), ("provinces", "Test Province", " TP ", 9),
]
CASES = [
    ("龙羊峡水库", True, "龙羊峡水库", "exact", 1.0), ("龙库", True, "龙羊峡水库", "alias", 0.95), ("甘肃省", True, "甘肃省", "exact", 1.0), ("青海省", True, "青海省", "exact", 1.0),
    ("不存在的实体名称XYZ", False, "不存在的实体名称XYZ", "none", 0.0), ("", False, None, "none", 0.0), (None, False, None, "none", 0.0), ("龙库以上", True, "龙羊峡以上", "alias", 0.95),
    ("兰州站", True, "兰州水文站", "alias", 0.95), ("三门峡", True, "三门峡水库", "alias", 0.95), ("玛尔挡", False, "玛尔挡", "none", 0.0), ("tp", True, "Test Province", "alias", 0.95), ("TP", True, "Test Province", "alias", 0.95),
]


@pytest.fixture(scope="module")
def index(spark):
    return linking.alias_index(spark.createDataFrame(ALIASES, "category string, standard string, alias string, ord int"))


def test_link_cases(spark, index):
    names = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, name string")
    got = {r.i: r for r in linking.link(names, index).collect()}
    for i, (_, matched, standard, method, confidence) in enumerate(CASES):
        r = got[i]
        assert (r.matched, r.standardized, r.method, r.confidence) == (matched, standard, method, confidence), CASES[i]


def test_override_wins(spark, index):
    extra = spark.createDataFrame([("三门峡", "三门峡水文站")], "key string, standard string")
    rows = {r.key: r.standard for r in linking.override(index, extra).collect()}
    assert rows["三门峡"] == "三门峡水文站" and rows["龙库"] == "龙羊峡水库"


def test_link_triples_keeps_blank_names(spark, index):
    raw = spark.createDataFrame([("龙库", ""), (None, "兰州站")], "subject string, object string")
    got = {(r.subject, r.object, r.subject_link_confidence, r.object_link_confidence) for r in linking.link_triples(raw, index).collect()}
    assert got == {("龙羊峡水库", "", 0.95, 1.0), (None, "兰州水文站", 1.0, 0.95)}


def test_vector_ties_and_zero(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "i int, v array<float>")
    anchors = spark.createDataFrame([("b", [2.0, 0.0]), ("a", [1.0, 0.0])], "name string, v array<float>")
    got = {r.i: (r.best_name, r.matched) for r in linking.link_by_vector(vectors.withColumnRenamed("i", "i"), anchors, "i", "v", "name").collect()}
    assert got[1] == ("a", True) and got[2][1] is False and got[3][1] is False
