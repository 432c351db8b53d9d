"""The document source: one parse a file, partitions by bytes, an error table, and streams that take every file once."""

import json

import pytest

from kilngraph.sources import document_source as D
from kilngraph.sources import readers


def parse(content: bytes) -> list[dict]:
    """Pages of a JSON file, which also says where to note the call."""
    text = json.loads(content)
    with open(text["counter"], "a") as file:
        file.write(text["name"] + "\n")
    if text.get("bad"):
        raise ValueError("bad file")
    return text["pages"]


def calls(folder) -> list[str]:
    return sorted((folder / "calls").read_text().split()) if (folder / "calls").exists() else []


def put(folder, name, pages=1, **more):
    path = folder / "in" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"counter": str(folder / "calls"), "name": path.stem, "pages": [{"native_text": f"{path.stem} {i}", "tables": [{"markdown": "m"}], "boxes": [{"label": "image", "bbox": [1, 2]}]} for i in range(pages)], **more}))


@pytest.fixture
def source(spark):
    spark.dataSource.register(D.DocumentSource)
    return lambda kind, folder, **options: kind.format("documents").option("parser", f"{__name__}:parse").options(**options).load(str(folder / "in"))


def test_batch(spark, tmp_path, source):
    for i in range(12):
        put(tmp_path, f"deep{i % 3}/f{i:02d}.{'PDF' if i % 2 else 'pdf'}", pages=i % 4)
    put(tmp_path, "x/bad.pdf", bad=True)
    put(tmp_path, ".hidden/f.pdf"), put(tmp_path, "_tmp/f.pdf"), put(tmp_path, "other.txt")
    pages, errors = readers.parsed(source(spark.read, tmp_path, partitionBytes=700))
    texts = readers.page_text(pages, layout=True)
    assert texts.count() == 1 + sum(i % 4 for i in range(12)) and readers.documents(pages.withColumns({"is_noise": pages.page_num < 0, "text": pages.native_text})).count() == 10
    row = pages.where("native_text = 'f03 2'").first()
    assert (row.page_num, row.found_tables[0].markdown, row.boxes[0].bbox, row.path.endswith("f03.PDF")) == (3, "m", [1.0, 2.0], True)
    assert [(r.path.split("/")[-1], r.error) for r in errors.collect()] == [("bad.pdf", "ValueError: bad file")]
    assert calls(tmp_path) == ["bad", *[f"f{i:02d}" for i in range(12)]]


def test_partitions_by_bytes(tmp_path):
    files = [(f"f{i}", n) for i, n in enumerate([5, 5, 30, 1, 9, 1])]
    assert [p.value for p in D.runs(files, 10)] == [["f0", "f1"], ["f2"], ["f3", "f4"], ["f5"]] and D.runs([], 10) == []
    assert D.listing(str(tmp_path / "none"), ["*"]) == []


def test_stream_takes_every_file_once(spark, tmp_path, source):
    def run():
        stream = source(spark.readStream, tmp_path, log=str(tmp_path / "log"), maxFilesPerTrigger=2)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.native_text for r in spark.read.parquet(str(tmp_path / "out")).where("error is null").collect())

    for i in range(5):
        put(tmp_path, f"f{i}.pdf", bad=i == 3)
    assert run() == ["f0 0", "f1 0", "f2 0", "f4 0"]
    assert len(list((tmp_path / "log").glob("entry-*.json"))) == 3
    put(tmp_path, "a_late_one.pdf"), put(tmp_path, "f9.pdf", pages=2)
    assert run() == ["a_late_one 0", "f0 0", "f1 0", "f2 0", "f4 0", "f9 0", "f9 1"]
    assert calls(tmp_path) == sorted(["f0", "f1", "f2", "f3", "f4", "a_late_one", "f9"])
    assert spark.read.parquet(str(tmp_path / "out")).where("error is not null").count() == 1
