"""Documents to a graph, file by file: readers, engine choice, tables, extraction, sinks, command line, service."""

import json

import pytest
from pyspark.sql import functions as F

from kilngraph import service
from kilngraph.__main__ import main
from kilngraph.operators import documents, extraction, linking, normalising
from kilngraph.operators import queries as R
from kilngraph.sources import readers, sinks

TABLE = "| 名称 | 库容(亿m³) |\n| --- | --- |\n| 甲水库 | 3.5 |\n| 乙水库 | 无 |\n| 丙水库 | 8 |\n| 丁水库 | 9 |"


def parse(content: bytes) -> list[dict]:
    return json.loads(content)["pages"]


def model(prompts: list[str], max_tokens: int) -> list[str]:
    """One triple per data row of a table prompt, one fixed triple per text prompt."""
    out = []
    for prompt in prompts:
        rows = [[c.strip() for c in x.strip("|").split("|")] for x in prompt.split("\n") if x.startswith("| ") and "---" not in x][1:]
        found = [{"subject": r[0], "relation": "总库容为", "object": r[1]} for r in rows] if max_tokens == extraction.TABLE_TOKENS else [{"subject": "甲水库", "relation": "死水位为", "object": "120m", "data_type": "note"}]
        out.append("```json\n" + json.dumps(found, ensure_ascii=False) + "\n```")
    return out


@pytest.fixture
def files(tmp_path):
    """One scanned file with a table, one with native text, one image, one broken file, and a file of another kind."""
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    text = "首行\n甲水库的死水位为120m，正常蓄水位为150m，由水利部门于2020年核定并公布执行，供各地参照使用，每年汛前复核一次并公布。\n第二行也有足够的内容，说明2021年与2022年的变化。\n末行"
    (folder / "scan.PDF").write_text(json.dumps({"pages": [{"rec_texts": ["眉", "扫描页一2020年 12 34", "", "脚", "尾"], "tables": [{"markdown": "", "html": "<table></table>"}, {"markdown": TABLE}], "boxes": [{"label": "image", "bbox": [1, 2, 3, 4]}, {"label": "text", "bbox": []}]}]}))
    (folder / "native.pdf").write_text(json.dumps({"pages": [{"native_text": text, "tables": [{"markdown": TABLE}]}, {"native_text": "短", "ocr_text": "识别的文字 2020年 1 2 3"}]}))
    (folder / "shot.png").write_text(json.dumps({"pages": [{"ocr_text": "1行1\n2行水库 2020 2021\n3行3\n4行4"}, {"ocr_text": "第二页"}]}))
    (folder / "bad.pdf").write_text("no json")
    (folder / "notes.txt").write_text("x")
    return tmp_path


def pages_of(spark, root, layout=True):
    return readers.page_text(readers.parse_pages(readers.binary_files(spark, str(root / "in"), readers.PDF_GLOB), parse), layout=layout)


def test_engine_is_chosen_by_scan_detection(spark, files):
    got = {(r.path.split("/")[-1], r.page_num): r for r in pages_of(spark, files).collect()}
    assert (got["scan.PDF", 1].engine, got["scan.PDF", 1].method, len(got["scan.PDF", 1].tables)) == ("layout", "layout", 1)
    assert (got["native.pdf", 1].method, got["native.pdf", 2].method, got["native.pdf", 1].tables) == ("native", "ocr", [])
    assert got["bad.pdf", 0].error.startswith("JSONDecodeError")
    assert not got["native.pdf", 1].text.startswith("首行") and "末行" not in got["native.pdf", 1].text
    without = {(r.path.split("/")[-1], r.page_num): r.method for r in pages_of(spark, files, layout=False).collect()}
    assert without["scan.PDF", 1] == "ocr"


def test_recognition_result(spark, files):
    rows = readers.recognised(readers.parse_pages(readers.binary_files(spark, str(files / "in"), readers.PDF_GLOB), parse))
    got = {(r.source_file, r.page_num): r for r in rows.collect()}
    scan = got["scan.PDF", 1]
    assert (scan.is_empty, scan.char_count, [i.bbox for i in scan.images]) == (False, len(scan.plain_text), [[1.0, 2.0, 3.0, 4.0]])
    assert [(t.table_id, t.headers, t.row_count, t.col_count) for t in scan.tables] == [("tbl_p1_01", ["名称", "库容(亿m³)"], 4, 2)]
    assert scan.markdown_text == scan.plain_text + "\n\n" + TABLE
    assert got["native.pdf", 2].is_empty is False and got["bad.pdf", 0].is_empty


def test_images_are_one_page_and_judged_before_trimming(spark, files):
    rows = readers.image_text(readers.parse_pages(readers.binary_files(spark, str(files / "in"), readers.IMAGE_GLOB), parse)).collect()
    assert [(r.page_num, r.text, r.is_noise) for r in rows] == [(1, "2行水库 2020 2021\n3行3", False)]


def test_documents_and_their_output_files(spark, files):
    pages = pages_of(spark, files)
    docs = readers.documents(pages)
    got = {r.path.split("/")[-1]: r for r in docs.collect()}
    assert got["native.pdf"].page_count == 2 and "\n\n" in got["native.pdf"].full_text and len(got["scan.PDF"].tables) == 1
    sinks.write_parsed(docs, pages, str(files / "parsed"))
    meta = {r.path.split("/")[-1]: r for r in spark.read.json(str(files / "parsed/meta")).collect()}
    assert (meta["scan.PDF"].is_scanned, meta["scan.PDF"].table_count, meta["native.pdf"].is_scanned) == (True, 1, False)
    assert spark.read.json(str(files / "parsed/tables")).select("document", "row_count").collect() == [("scan.PDF", 4)]
    assert spark.read.text(str(files / "parsed/texts")).where("document = 'native.pdf'").count() > 2


def test_extraction_of_texts_and_tables(spark, files):
    rows = documents.extract(documents.intermediate(pages_of(spark, files)), model).orderBy("seq").collect()
    texts, tables = [r for r in rows if r.data_type == "note"], [r for r in rows if r.data_type == "tabular"]
    assert {(r.source_file, r.table_id) for r in texts} == {("native.pdf", None), ("scan.PDF", None)} or {r.source_file for r in texts} == {"native.pdf"}
    assert all(r.chunk_id.startswith("chunk_") and r.page_num >= 1 for r in texts)
    # The header's unit is moved to values with digits; three rows a prompt.
    assert [(r.subject, r.object, r.table_id, r.page_num) for r in tables] == [("甲水库", "3.5亿m³", "tbl_p1_01", 1), ("乙水库", "无", "tbl_p1_01", 1), ("丙水库", "8亿m³", "tbl_p1_01", 1), ("丁水库", "9亿m³", "tbl_p1_01", 1)]
    assert [r.seq for r in rows] == sorted(r.seq for r in rows)


def test_published_table_numbers(spark):
    row = spark.createDataFrame([([{"markdown": TABLE, "html": None}] * 2, 3)], "found_tables array<struct<markdown:string,html:string>>, page_num int")
    assert [t.table_id for t in readers.page_tables(row).first().tables] == ["tbl_p3_00", "tbl_p3_01"]
    assert [t.table_id for t in readers.page_tables(row, published=True).first().tables] == ["tbl_p3_00", "tbl_p3_00"]


def test_command_line_from_files_to_graph(spark, files, capsys):
    hook = f"{__name__}:parse", f"{__name__}:model"
    main(["documents", "--files", str(files / "in"), "--parser", hook[0], "--out", str(files / "mid"), "--layout"], spark)
    assert {r.source_file for r in readers.intermediate(spark, str(files / "mid")).collect()} == {"scan.PDF", "native.pdf", "bad.pdf"}
    extract = ["extract", "--intermediate", str(files / "mid"), "--model", hook[1], "--out", str(files / "out"), "--graph", str(files / "graph")]
    main([*extract, "--dry-run"], spark)
    assert "'nodes'" in capsys.readouterr().out and sinks.GraphStore(spark, str(files / "graph")).generation() is None
    main(extract, spark)
    assert {r.subject for r in spark.read.json(str(files / "out/all")).collect()} == {"甲水库", "丙水库", "丁水库"}
    assert {r.source_file for r in spark.read.json(str(files / "out/by_file")).select("source_file").distinct().collect()} <= {"scan.PDF", "native.pdf"}
    store = sinks.GraphStore(spark, str(files / "graph"))
    before = store.nodes().count()
    main([*extract, "--mode", "append"], spark)
    assert store.nodes().count() == before == store.nodes().select("id").distinct().count()
    main(["clear", "--graph", str(files / "graph"), "--yes"], spark)
    assert store.generation() is None


def test_intermediate_and_training_files(spark, tmp_path):
    (tmp_path / "a_intermediate.json").write_text(json.dumps({"source_file": "a.pdf", "chunks": [{"chunk_id": "chunk_0000", "content": "文"}], "tables": []}, indent=1))
    (tmp_path / "other.json").write_text("{}")
    assert [(r.source_file, r.chunks[0].page_num) for r in readers.intermediate(spark, str(tmp_path)).collect()] == [("a.pdf", None)]
    assert documents.text_prompts(readers.intermediate(spark, str(tmp_path))).first().page_num == 1
    (tmp_path / "train.jsonl").write_text(json.dumps({"text": "t", "triples": [{"subject": "s", "relation": "r", "object": "o"}]}) + "\n" + json.dumps({"text": "u"}))
    assert [(r.text, r.triples and r.triples[0].subject) for r in readers.json_lines(spark, str(tmp_path / "train.jsonl")).collect()] == [("t", "s"), ("u", None)]
    kinds = tmp_path / "relation.json"
    kinds.write_text(json.dumps({"HAS": {"description": "d", "subject_type": "A/B", "object_type": "C", "category": "x"}}))
    assert readers.ontology(spark, str(kinds), "relation").first().subject_types == ["A", "B"]


def test_report_command(spark, tmp_path, capsys):
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"subject": "甲水库", "relation": "总库容为", "object": "3亿m³"}, {"subject": "甲水库", "relation": "unknown", "object": "x"}], ensure_ascii=False))
    main(["report", "--triples", str(path), "--out", str(tmp_path / "n"), "--stats-only"], spark)
    assert "50.0" in capsys.readouterr().out and not (tmp_path / "n").exists()
    main(["report", "--triples", str(path), "--out", str(tmp_path / "n")], spark)
    assert spark.read.json(str(tmp_path / "n")).count() == 2


def test_normalised_rows_pass_and_a_resolver_names_the_rest(spark):
    raw = spark.createDataFrame([(1, "甲水库", "很特别的量", "3亿m³", None, 0.9, "f2020.pdf"), (2, "甲水库", "总库容为", "5亿m³", None, 0.9, "f.pdf")], "seq long, subject string, relation string, object string, context string, confidence double, source_file string")
    asked = []
    once = normalising.normalise(raw, resolver=lambda phrases: [("WATER_USE", 0.5) for _ in phrases])
    got = {r.seq: r for r in once.collect()}
    assert (got[1].relation_id, got[1].rel_method, got[1].year, got[1].confidence) == ("WATER_USE", "llm", 2020, 0.45) and got[2].rel_method == "exact" and not asked
    assert sorted(map(str, normalising.normalise(once).collect())) == sorted(map(str, once.collect()))


def test_fuzzy_links_by_an_encoder_and_counts(spark):
    encoder = lambda names: [[float(len(n)), float(n.count("a"))] for n in names]
    names, standards = spark.createDataFrame([("aaa",), ("bb",), (None,)], "name string"), spark.createDataFrame([("aaaa",), ("bbbb",)], "standard string")
    assert {(r.name, r.best_name) for r in linking.link_fuzzy(names, standards, encoder).collect()} == {("aaa", "aaaa"), ("bb", "bbbb")}
    index = spark.createDataFrame([("x", "X")], "key string, standard string")
    assert linking.link_counts(linking.link(spark.createDataFrame([("x",), ("y",), ("",)], "name string"), index)).first() == (3, 1)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("R1", "Reservoir", "甲水库"), ("R2", "Reservoir", "乙水库"), ("C1", "Constraint", "c"), ("D1", "DispatchRule", "汛期规则"), ("S1", "HydrologicalStation", "站"), ("Z1", "WaterResourceZone", "区"), ("A1", "AnnualHydrologyData", "9亿m³")]
    nodes = spark.createDataFrame([(*n, "120m" if n[0] == "C1" else "按规程" if n[0] == "D1" else None, None, None, None, None, None, None) for n in nodes], "id string, label string, name string, value string, numeric_value double, unit string, year int, indicator string, variable string, source_file string")
    edges = [("R1", "上距乙水库12km", "C1", None, None), ("R1", "死水位为", "C1", "DEAD_STORAGE_LEVEL", None), ("R1", "调度规则", "D1", None, None), ("S1", "径流量为", "A1", "ANNUAL_RUNOFF", 2020), ("Z1", "供水量为", "A1", "WATER_SUPPLY", 2020), ("R1", "年径流量为", "A1", "ANNUAL_RUNOFF", 2020), ("R1", "年径流量为", "A1", "ANNUAL_RUNOFF", 2021)]
    edges = spark.createDataFrame([(s, r, d, i, y, 0.9, "ctx", "doc.pdf") for s, r, d, i, y in edges], "src string, rel string, dst string, relation_id string, year int, confidence double, context string, source_doc string")
    return service.GraphService(nodes, edges)


def test_service_reads(graph):
    assert [r.t_name for r in graph.rules("R1").collect()] == ["汛期规则"] and {r.rel for r in graph.raw_constraints("R1").collect()} == {"上距乙水库12km", "死水位为"}
    assert [r.id for r in graph.search_reservoirs("乙").collect()] == ["R2"] and [r.id for r in graph.stations().collect()] == ["S1"]
    assert [r.year for r in graph.station_data("S1").collect()] == [2020] and graph.station_data("S1", 1999).isEmpty()
    assert [r.id for r in graph.zones().collect()] == ["Z1"] and [r.value for r in graph.zone_data("Z1", 2020).collect()] == [None]
    assert graph.optimisation_reservoirs().count() == 2 and graph.search("水库").count() == 5 and graph.trace("doc.pdf").count() == 7


def test_formulations_with_rules_relations_and_stubs(graph):
    one = graph.formulate_one("R1")
    assert one["dispatch_rules"][0]["content"] == "按规程" and one["time_series"]["count"] == 2
    assert "dispatch_rules" not in graph.formulate(["R1"], include_rules=False).columns and "time_series" not in graph.formulate(["R1"], include_hydrology=False).columns
    assert graph.formulate_one("R1", year=2021)["time_series"]["count"] == 1
    batch = graph.formulate_batch(["R1", "R2", "none"])
    assert batch["relations"] == [{"from": "R1", "from_name": "甲水库", "to": "R2", "to_name": "乙水库", "relation": "upstream"}]
    assert batch["reservoirs"]["none"]["problem_meta"] == {"id": "none", "name": "none"} and batch["reservoirs"]["R2"]["constraints"] == []


def test_solver_document(graph):
    plain, dated = graph.solver_ready(["R1", "R2"]).first(), graph.solver_ready(["R1", "R2"], 2020).first()
    assert plain.time_series == {} and plain.meta.time_series_years == [] and plain.meta.reservoir_count == 2
    assert dated.time_series["甲水库"]["年径流量为"][0].year == 2020 and dated.meta.time_series_years == [2020]
    assert "Z_1 >= 120.0" in [c.expression for c in dated.constraints] and dated.objective_hints == sorted(dated.objective_hints)


def test_envelopes(graph):
    broken = lambda error: service.respond(lambda: (_ for _ in ()).throw(error))["code"]
    assert [broken(e) for e in (ValueError("x"), LookupError("x"), ConnectionError("x"), RuntimeError("x"))] == [400, 404, 503, 500]
    assert service.respond(lambda: graph.formulate_one("none"))["code"] == 404 and service.respond(lambda: graph.formulate([]))["code"] == 400
    assert service.respond(lambda: graph.zones())["data"] == [{"name": "区", "id": "Z1"}] and service.respond(lambda: graph.reservoir("none"))["code"] == 404
    answer = graph.ask("甲水库的径流2020", lambda q: __import__("kilngraph.operators.questions", fromlist=["Slots"]).Slots("甲水库", "径流", (2020,)))["data"]
    assert answer["rows"] == 1 and "relation contains" in answer["query"] and set(answer["timing"]) == {"slots", "graph", "total"}


def test_upstream_pairs_take_any_number_of_entities(spark, graph):
    who = graph.nodes.where("label = 'Reservoir'").select("id", F.when(F.col("id") == "R1", 2).otherwise(1).alias("ord"))
    assert R.upstream_pairs(graph.nodes, graph.edges, who).collect() == []
    assert [(r.upstream, r.downstream) for r in R.upstream_pairs(graph.nodes, graph.edges, who, symmetric=True).collect()] == [("R1", "R2")]
