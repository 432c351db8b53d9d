"""Queries whose shuffles, memory or tasks once grew faster than their input."""

import json

from kilngraph.operators import extraction, mentions, patterns, queries
from kilngraph.operators.substrings import SubstringIndex
from kilngraph.plans import bind
from kilngraph.plans.catalogue import CATALOGUE

SF = "/root/testdata/sf0.001"


def optimised(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_parsed_table_do_not_carry_their_table(spark):
    plan = optimised(CATALOGUE["md_parse"](spark, SF))
    assert plan.count("regexp_replace(regexp_replace(") == 1  # the lines are split once
    kept = next(line for line in plan.split("\n") if "Generate posexplode" in line)
    assert " t#" not in kept and "markdown#" not in kept and "[4]" in kept  # the fifth column, the exploded one, is left out


def test_a_dictionary_of_many_parts_reads_texts_once(spark):
    texts = spark.range(40).selectExpr("id as i", "concat('n', id, '水库') as text")
    names = spark.range(30).selectExpr("concat('n', id) as name")
    frame = mentions.longest(texts, names, ["i"], most_names=3)
    assert optimised(frame).count("MapInArrow") == 0  # ten passes before
    want = {i: max((n for n in (f"n{j}" for j in range(30)) if n in f"n{i}水库"), key=len, default=None) for i in range(40)}
    assert {r.i: r.mention for r in frame.collect()} == want


def test_repair_tries_ends_of_values_only(monkeypatch):
    tried, loads = [], json.loads
    monkeypatch.setattr(extraction.json, "loads", lambda text: tried.append(text) or loads(text))
    item = '{"subject": "a0 \\" lonely", "relation": "elNy 0123456789", "object": "1"}'
    second = item[: item.index(', "object"')] + "}"
    for text, want in [(f"[{item}, " + item[:-3], f"[{item}, {second}]"), (f"[{item}, " + item[:5], f"[{item}]"), ("[1, 2", "[1, 2]"), ('["\\u', None), ("[nul", None)]:
        tried.clear()
        assert extraction.repair_array(text) == want
        assert len(tried) < 12  # one for every letter e, l, N, y and digit before


def test_answers_and_orders_are_dealt_to_all_tasks(spark):
    for frame in (CATALOGUE["json_repair"](spark, SF), bind.raw_triples(spark, SF)):
        assert "RepartitionByExpression" in optimised(frame)


def test_pairs_of_ends_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 3)
    ends = [(f"{k}{i}", k, f"{k}{i}") for k in "RS" for i in range(20)]
    nodes = spark.createDataFrame([*ends, *[(f"V{j}", "V", f"v{j}") for j in range(4)]], "id string, label string, name string")
    links = [(f"{k}{i}", "on", f"V{j}", y) for k in "RS" for i in range(1, 20) for j in {i % 4, i % 3} for y in (1, 2)]
    edges = spark.createDataFrame(links, "src string, rel string, dst string, year int")
    left, right, middle = (patterns.Node(label=x) for x in "RSV")
    frame = patterns.shared(nodes, edges, left, right, middle, patterns.Step(contains="on"))
    met = lambda i: {i % 4, i % 3}
    want = sorted((f"R{a}", f"S{b}", len(met(a) & met(b))) for a in range(1, 20) for b in range(1, 20) if met(a) & met(b))
    assert sorted(map(tuple, frame.collect())) == want
    assert optimised(frame).count("Aggregate") == 0  # pairs are only joined


def test_places_hand_on_their_first_facts_only(spark):
    nodes = [(f"R{i}", "Reservoir", "r", None, None) for i in range(3)] + [(f"S{i}", "HydrologicalStation", "s", None, None) for i in range(30)] + [("V", "River", "v", None, None)]
    nodes += [(f"D{i}", "AnnualHydrologyData", "d", f"{i:02d}", "mm") for i in range(30)]
    edges = [(f"R{i}", "on", "V", "LOCATED_ON", None) for i in range(3)] + [(f"S{i}", "on", "V", "LOCATED_ON", None) for i in range(30)] + [(f"S{i}", "rain", f"D{29 - i}", "ANNUAL_PRECIPITATION", 2000 + i) for i in range(30)]
    frame = queries.series_or_neighbours(spark.createDataFrame(nodes, "id string, label string, name string, value string, unit string"), spark.createDataFrame(edges, "src string, rel string, dst string, relation_id string, year int"), most=4)
    assert sorted((r.entity, r.station, r.year, r.value) for r in frame.collect()) == [(f"R{i}", f"S{j}", 2000 + j, f"{29 - j:02d}") for i in range(3) for j in range(4)]
    assert optimised(frame).count("WindowGroupLimit") == 2  # of places, and of entities


def test_keywords_are_counted_by_numbers_of_texts(spark, tmp_path):
    names = ["b7", "a77", "77", "x", "水7库77", None, ""]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    index = SubstringIndex.build(rows, str(tmp_path / "i"))
    words = ["7", "77", "水7库", "水7库7", "zz", "", None, "b7"]
    got = sorted(map(tuple, index.summary(spark.createDataFrame([(w,) for w in words * 2], "keyword string")).collect()))
    want = sorted((w, len(h), min(h)) for w in words if w for h in [[n for n in names if n and w in n]] if h)
    assert got == want
