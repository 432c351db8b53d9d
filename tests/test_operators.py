"""Text, table, extraction, normalisation, formulation and graph operators on edge cases."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilngraph.functions import tables as M
from kilngraph.functions import text as T
from kilngraph.operators import chunking, extraction, formulation, graph, normalising, paths, questions, training
from kilngraph.plans.catalogue import CATALOGUE
from kilngraph.sources.config import Config


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "clean"), [("黄河\n水库 站", "黄河水库站"), (None, ""), ("", ""), ("  a\n\n\n\nb ", "a\nb"), ("x--y——z", "x—y—z"), ("!!!!!!!!", "")])
def test_clean(spark, raw, clean):
    rows = spark.createDataFrame([(raw,)], "t string")
    assert rows.select(T.clean(F.col("t")).alias("x")).first().x == clean


def reference_chunks(text, size, overlap):
    """The greedy merge as a plain loop."""
    import re

    strip = lambda s: re.sub(r"^\s+|\s+$", "", s)
    if not text or not strip(text):
        return []
    if len(text) <= size:
        return [text]
    force = lambda t: [p for p in (strip(t[i : i + size]) for i in range(0, len(t), size - overlap)) if p]
    for sep in ["\n\n", "\n", "。", ".", "；", ";", " "]:
        parts = [p for p in map(strip, text.split(sep)) if p]
        if len(parts) > 1:
            break
    else:
        return force(text)
    out, cur = [], None
    for p in parts:
        if cur is None:
            cur = p
        elif len(cur) + len(p) + 1 <= size:
            cur += "\n" + p
        elif len(p) > size:
            out.append(cur)
            *head, cur = force(p)
            out += head
        else:
            out.append(cur)
            cur = p
    return [*out, cur]


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab .\n;。", max_size=120), min_size=1, max_size=20))
def test_chunks_match_plain_loop(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in chunking.split_text(rows, size=20, overlap=5).collect():
        got.setdefault(r.i, []).append((r.chunk_index, r.content))
    for i, t in enumerate(texts):
        assert [c for _, c in sorted(got.get(i, []))] == reference_chunks(t, 20, 5), t


def test_whole_documents_match_plain_loop(spark, tmp_path):
    texts = ["short", "a" * 4500, " \n", None, "line of words. " * 300, "\n\n".join("p" * n for n in (700, 1500, 2600, 10)), "end"]
    rows = [(i, "even" if i % 2 == 0 else "odd", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = {i: [(len(c), hashlib.md5(c.encode()).hexdigest()) for c in reference_chunks(t, 2000, 200)] for i, _, t in rows}
    assert sorted(map(tuple, CATALOGUE["chunk_whole"](spark, str(tmp_path)).collect())) == [(i, f"chunk_{k:04d}", *c) for i in chunks for k, c in enumerate(chunks[i])]
    want = []
    for source in ("even", "odd"):
        pages = [(i, c) for i, s, _ in rows if s == source for c in chunks[i]]
        want += [(source, i, f"chunk_{k:04d}", *c) for k, (i, c) in enumerate(pages)]
    got = CATALOGUE["doc_renumber_whole"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[2])) == want and max(len(c) for c in chunks.values()) > 1


def test_tables(spark):
    md = "| 水库 | 库容(亿m³) |\n|---|---|\n| 龙羊峡 | 247 |\n| x | - |"
    assert one(spark, M.embed_units(F.col("m")), m=md) == "| 水库 | 库容 |\n|---|---|\n| 龙羊峡 | 247亿m³ |\n| x | - |"
    parsed = one(spark, M.parse_markdown(F.col("m")), m=md)
    assert parsed.headers == ["水库", "库容(亿m³)"] and parsed.rows == [["龙羊峡", "247"], ["x", "-"]]
    rows = "\n".join(f"| {i} |" for i in range(8))
    assert [len(p.split("\n")) for p in one(spark, M.split_rows(F.col("m"), 3), m=f"| a |\n|-|\n{rows}")] == [5, 5, 4]
    assert one(spark, M.html_to_markdown(F.col("h")), h="no markup") == "no markup"
    assert one(spark, M.html_to_markdown(F.col("h")), h="<table></table>") == ""
    assert one(spark, M.html_to_markdown(F.col("h")), h="<table><tr><th>a</th></tr><tr><td>1 <b>x</b></td></tr></table>") == "| a |\n| --- |\n| 1 x |"


def test_parse_and_repair(spark):
    t = {"subject": "s", "relation": "r", "object": "o"}
    full = json.dumps([t, t])
    answers = [full, f"```json\n{full}\n```", json.dumps({"triplets": [t]}), json.dumps({"data": [t]}), f"Sure: {full}", full[:-12], full[:-1], "", None, "nothing", '[{"subject": "s"']
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string")
    got = {r.i: r.t for r in rows.select("i", extraction.parse_response(F.col("a")).alias("t")).collect()}
    assert [len(got[i] or []) for i in range(len(answers))] == [2, 2, 1, 1, 2, 1, 2, 0, 0, 0, 0]
    assert got[0][0].confidence == 0.85 and got[0][0].data_type == "text"


def test_cut_answers_of_every_shape_keep_their_first_item(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "props").collect()
    want = sorted((e.event_id, f"u{e.user_id}", e.event_type, str(json.loads(e.props)["k"]), e.event_id % 4) for e in events)
    assert {e.event_id % 12 for e in events} == set(range(12))
    assert sorted(map(tuple, CATALOGUE["json_repair_shapes"](spark, sf).collect())) == want


def test_generate_skips_blank_prompts(spark):
    rows = spark.createDataFrame([(1, "ask"), (2, " "), (3, None)], "i int, prompt string")
    got = {r.i: r.response for r in extraction.generate(rows, lambda ps, n: [p.upper() for p in ps]).collect()}
    assert got == {1: "ASK", 2: "", 3: ""}


RAW = "seq long, subject string, relation string, object string, context string, confidence double, source_file string"


def test_normalise_edge_cases(spark):
    rows = [
        (1, "玛尔挡水电站", "总库容为", "14.82亿立方米", "", 1.0, ""), (2, "万家寨水库", "左岸所属行政区为", "山西省偏关县", "", 1.0, ""), (3, "小浪底水库", "所在地区为", "河南省洛阳市以北40公里", "", 1.0, ""),
        (4, "x", "上年降水量为", "5毫米", "", None, "bulletin2024.pdf"), (5, "x", "与1987~2016年均值比2024年径流", "1%", "", 0.5, None), (6, "x", "包括", "龙羊峡以上、兰州至头道拐", None, 0.8, ""), (7, "x", "y", "无", "", 0.8, ""), (8, None, None, None, None, None, None),
    ]
    got = {(r.seq, r.part): r for r in normalising.normalise(spark.createDataFrame(rows, RAW)).collect()}
    assert (got[1, 0].relation_id, got[1, 0].object_type, got[1, 0].confidence, got[1, 0].subject_type) == ("TOTAL_CAPACITY", "numerical_value", 0.99, "Reservoir")
    assert (got[2, 0].rel_method, got[2, 0].confidence, got[2, 0].object_type) == ("keyword:所属", 0.85, "entity_reference")
    assert got[3, 0].object_type == "numerical_value"
    assert (got[4, 0].year, got[5, 0].year) == (2023, 2024)
    assert {got[6, p].object for p in (0, 1)} == {"龙羊峡以上", "兰州至头道拐"}
    assert not {k for k in got if k[0] in (7, 8)}


def test_dedupe_prefers_dated_then_confident_then_first(spark):
    rows = [(1, 0, "a", "r", "o", 2024, 0.9), (2, 0, "a", "2024年r", "o", 2024, 0.5), (3, 0, "b", "r", "o", None, 0.5), (4, 0, "b", "q", "o", None, 0.5)]
    frame = spark.createDataFrame(rows, "seq long, part int, subject string, relation string, object string, year int, confidence double")
    assert sorted(r.seq for r in normalising.deduplicate(frame).collect()) == [2, 3]
    assert normalising.deduplicate(normalising.deduplicate(frame)).count() == 2


@pytest.mark.parametrize(("phrase", "meant", "published"), [("不低于", ">=", "<="), ("不小于", ">=", "<="), ("不少于", ">=", ">="), ("大于等于", ">=", ">="), ("小于等于", "<=", "<="), ("不高于", "<=", "<="), ("高于", ">=", ">="), ("总库容为", "==", "=="), ("出库流量控制 500m³/s", "==", "=="), ("正常蓄水位", None, None)])
def test_operator_words(spark, phrase, meant, published):
    assert one(spark, formulation.extract_operator(F.col("p")), p=phrase) == meant
    assert one(spark, formulation.extract_operator(F.col("p"), published=True), p=phrase) == published


@pytest.mark.parametrize(("text", "value", "unit"), [("14.82亿立方米", 14.82, "亿立方米"), ("2530m", 2530.0, "m"), ("3km²", 3.0, "km²"), ("1.2亿kWh", 1.2, "亿kWh"), ("-5.2米", 5.2, "米"), ("1,234.5吨", 1.0, None)])
def test_value_with_unit(spark, text, value, unit):
    got = one(spark, formulation.extract_numeric(F.col("t")), t=text)
    assert (got.value, got.unit) == (value, unit)


def test_graph_round_trip(spark, tmp_path):
    from kilngraph.sources.sinks import GraphStore

    raw = spark.createDataFrame([(1, "a水库", "总库容为", "5亿m³", "", 1.0, "d1"), (2, "a水库", "所在河流为", "黄河", "", 1.0, "d1")], RAW)
    triples = normalising.deduplicate(normalising.normalise(raw))
    nodes, edges = graph.build_nodes(triples), graph.build_edges(triples)
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.append(nodes, edges)
    before = {r.id for r in store.nodes().collect()}
    store.append(nodes, edges)
    assert {r.id for r in store.nodes().collect()} == before and store.edges().count() == 2
    assert graph.duplicate_ids(store.nodes()).isEmpty()
    assert before == {"Reservoir_" + __import__("hashlib").md5("Reservoir:a水库".encode()).hexdigest()[:8], *(r.id for r in nodes.where("label <> 'Reservoir'").collect())}
    with pytest.raises(ValueError):
        store.delete_all()


def test_shortest_paths(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("c", "b", "y"), ("c", "d", "z"), ("a", "e", "x"), ("e", "c", "w")], "src string, dst string, rel string")
    got = paths.shortest_paths(edges, "a", "d").collect()
    assert [r.nodes for r in got] == [["a", "b", "c", "d"], ["a", "e", "c", "d"]] and got[0].depth == 3
    assert paths.shortest_paths(edges, "a", "d", depth=2).isEmpty()
    assert paths.shortest_paths(edges, "a", "a").first().depth == 0


def test_shortest_paths_against_a_plain_search(spark):
    import itertools
    import random

    draw = random.Random(6)
    rows = [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}", draw.choice("xy")) for _ in range(17)] + [("lone", "pair", "z")]
    edges = spark.createDataFrame(rows, "src string, dst string, rel string")
    near = {}
    for a, b, r in rows:
        near.setdefault(a, set()).add((b, r)), near.setdefault(b, set()).add((a, r))
    for start, end in [*itertools.islice(itertools.combinations(sorted(near), 2), 0, 60, 9), ("n1", "lone"), ("pair", "lone")]:
        walks, want = [([start], [])], []
        for _ in range(4):
            walks = [([*n, b], [*r, x]) for n, r in walks for b, x in near[n[-1]] if b not in n]
            want = want or sorted(w for w in walks if w[0][-1] == end)[:5]
        assert [(r.nodes, r.rels) for r in paths.shortest_paths(edges, start, end).collect()] == want


def test_response_mask(spark):
    rows = spark.createDataFrame([(1, [5, 1, 2, 7], [1, 2]), (2, [5, 6], [1, 2]), (3, [1], [1, 2])], "i int, t array<int>, m array<int>")
    got = {r.i: r.labels for r in training.mask_prompt(rows, "t", "m").collect()}
    assert got == {1: [-100, -100, -100, 7], 2: [-100, -100], 3: [-100]}


def test_config():
    config = Config({"a": {"b": "${HOST:local}:${PORT}", "c": None}}, {"PORT": "1"})
    assert config.get("a.b") == "local:1" and config.get("a.c", 7) == 7 and config.get("a.x.y") is None


def test_streaming_append_is_idempotent(spark, tmp_path):
    from kilngraph.sources.sinks import GraphStore
    from kilngraph.streaming.append import append_stream

    folder = tmp_path / "in"
    spark.createDataFrame([(1, "a水库", "总库容为", "5亿m³", "", 1.0, "d1")], RAW).write.json(str(folder))
    store = GraphStore(spark, str(tmp_path / "graph"))
    for n in range(2):  # a new checkpoint replays everything
        append_stream(spark.readStream.schema(RAW).json(str(folder)), store, str(tmp_path / f"ck{n}"), availableNow=True).awaitTermination(120)
    assert store.nodes().count() == 2 and store.edges().count() == 1


def test_answers_of_any_columns(spark):
    plain = questions.answer(spark.createDataFrame([(i, None if i % 2 else "x") for i in range(9)], "count int, `odd col` string"), "q").first()
    assert plain.answer == "\n".join(f"• count: {i}, odd col: {'null' if i % 2 else 'x'}" for i in range(5)) + "\n... 共 9 条结果" and plain.n_rows == 9
    named = questions.answer(spark.createDataFrame([("a", 2020, None), ("", None, "7"), ("", None, "")], "name string, year int, value string"), "q").first()
    assert named.answer == "• a(2020年)\n• 7"
    assert questions.answer(spark.createDataFrame([], "x int"), "问").first().answer.startswith("未找到与「问」")


def test_observed_counters_equal_the_statistics(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"s{i % 5}水库", ["总库容为", "2020年供水量为", "odd"][i % 3], ["5亿m³", "甲河、乙河", "黄河"][i % 3], "", 0.9, "d") for i in range(30)], RAW)
    rows, watch = normalising.observed(normalising.normalise(raw))
    normalising.deduplicate(rows).write.parquet(str(tmp_path / "out"))
    found = normalising.statistics(raw, normalising.normalise(raw)).first().asDict()
    assert watch.get == {k: found[k] for k in watch.get} and found["total"] == 30 and found["kept"] == spark.read.parquet(str(tmp_path / "out")).count() == found["normalised"] - found["deduplicated"]
