"""Sources, sinks, the service surface and the command line on small files."""

import json

from kilngraph.__main__ import main
from kilngraph.operators import questions
from kilngraph.service import GraphService
from kilngraph.sources import readers
from kilngraph.sources.sinks import GraphStore

ALIASES = {"description": "text", "reservoirs": {"龙羊峡水库": ["龙库"], "青沟水库": []}, "rivers": {"黄河": ["黄河干流"]}}
TRIPLES = [
    {"subject": "龙库", "relation": "总库容为", "object": "247亿m³", "confidence": 1.0, "source_file": "b2024.pdf"},
    {"subject": "龙库", "relation": "死水位为", "object": "2530m", "confidence": 0.9, "source_file": "b2024.pdf"},
    {"subject": "龙库", "relation": "所在河流为", "object": "黄河干流"},
    {"subject": "兰州水文站", "relation": "所在河流为", "object": "黄河"},
    {"subject": "兰州水文站", "relation": "2024年降水量为", "object": "300毫米", "source_file": "b2024.pdf"},
]


def test_files_to_graph_to_service(spark, tmp_path, capsys):
    (tmp_path / "aliases.json").write_text(json.dumps(ALIASES), encoding="utf-8")
    (tmp_path / "triples.json").write_text(json.dumps(TRIPLES), encoding="utf-8")
    aliases = readers.alias_dictionary(spark, str(tmp_path / "aliases.json")).collect()
    assert {(r.category, r.standard, r.alias) for r in aliases} == {("reservoirs", "龙羊峡水库", "龙库"), ("reservoirs", "青沟水库", None), ("rivers", "黄河", "黄河干流")}
    assert readers.alias_dictionary(spark, str(tmp_path / "none.json")).count() == 0
    base = ["build", "--triples", str(tmp_path / "triples.json"), "--aliases", str(tmp_path / "aliases.json"), "--graph", str(tmp_path / "g")]
    main([*base, "--dry-run"], spark)
    assert "'edges': 5" in capsys.readouterr().out
    main(base, spark)
    main([*base, "--mode", "append"], spark)
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.edges().count() == 5
    service = GraphService(store.nodes(), store.edges())
    ids = {r.name: r.id for r in store.nodes().collect()}
    dam = ids["龙羊峡水库"]
    assert [r.id for r in service.reservoirs().collect()] == [dam]
    assert service.reservoir(dam)["code"] == 200 and service.reservoir("none")["code"] == 404
    assert len(service.reservoir(dam)["data"]["relations"]) == 3
    row = service.formulate([dam]).first()
    assert row.parameters.dead_storage_level.value == 2530.0 and {c.category for c in row.constraints} == {"storage", "water_level"}
    assert [(r.station, r.year) for r in service.hydrology([dam]).collect()] == [(ids["兰州水文站"], 2024)]
    assert service.path(dam, ids["兰州水文站"]).first().depth == 2
    assert {r.symbol for r in service.solver_tables([dam])[0].collect()} == {"Z_1", "V_1"}
    assert service.compare([dam]).where("parameter = '总库容'").first()["龙羊峡水库"] == "247.0亿m³"
    filler = questions.keyword_filler(["兰州"], ["降水"])
    assert "兰州水文站(2024年)" in service.ask("兰州2024年降水？", filler)["data"]["answer"]
    assert service.stats().where("label = 'total_edges'").first().n == 5
    # The same reads over the store itself, which read the files of the nodes concerned.
    direct = GraphService(store=store)
    rows = lambda frame: sorted(map(str, frame.collect()))
    for read in (lambda s: s.raw_constraints(dam), lambda s: s.constraints([dam]), lambda s: s.parameters([dam]), lambda s: s.trace("b2024.pdf"), lambda s: s.stations(), lambda s: s.formulate([dam]), lambda s: s.station_data(ids["兰州水文站"]), lambda s: s.stats()):
        assert rows(read(direct)) == rows(read(service))
    assert direct.reservoir(dam) == service.reservoir(dam) and direct.reservoir("none")["code"] == 404
    assert len(direct.raw_constraints(dam).inputFiles()) < len(direct.nodes.inputFiles()) + len(direct.edges.inputFiles())
    indexed = direct.index_names(str(tmp_path / "names"))
    for keyword in ("黄河", "水", "兰州水", "none"):
        assert rows(indexed.search(keyword)) == rows(service.search(keyword)) and rows(indexed.search_reservoirs(keyword)) == rows(service.search_reservoirs(keyword).select(indexed.nodes.columns))
    with service:
        pass
    assert not service.nodes.is_cached


def test_pages_with_a_broken_file(spark, tmp_path):
    for name, content in (("a.pdf", b"good"), ("b.PDF", b"bad"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(content)

    def parser(content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"native_text": "头\n" + "黄河水库调度方案说明文字\n" * 6 + "尾"}, {"ocr_text": "短"}]

    pages = readers.parse_pages(readers.binary_files(spark, str(tmp_path), readers.PDF_GLOB), parser)
    rows = readers.page_text(pages).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.page_num, r.method, r.error) for r in rows) == [("a.pdf", 1, "native", None), ("a.pdf", 2, "ocr", None), ("b.PDF", 0, "ocr", "ValueError: broken")]
    good = next(r for r in rows if r.page_num == 1)
    assert "头" not in good.text and not good.is_noise
    assert {r.path.rsplit("/", 1)[1]: r.is_scanned for r in readers.scanned(pages.where("error is null")).collect()} == {"a.pdf": False}
    assert readers.documents(readers.page_text(pages.where("error is null"))).first().page_count == 2


def test_text_directory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("黄河流域水库调度方案的说明文字，共三段。\n" * 3, encoding="utf-8")
    main(["chunks", "--texts", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark)
    assert spark.read.json(str(tmp_path / "out")).first().source_file == "x.txt"
