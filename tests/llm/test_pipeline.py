"""Every stage of the pipeline on empty tables, repeated rows, nulls, long texts and clashing columns; more cases of operators."""

import pytest

import corpus_pipeline
from kilngraph.llm import chat, line_dedup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, mark string, digest string, n long, stays boolean, score double, taken long, size string"
LONG = " ".join(f"word{i % 977} filler{i % 13} part{i}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, LONG, "en", "a", 9), (4, BASE, None, "b", 9), (4, BASE, None, "b", 9), (5, BASE.upper(), "de", "b", 9), (6, BASE.replace("w30 ", "x "), "en", "b", 9), (None, "text without id", "en", "c", 1), (7, "one", "en", "a", 1)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, "m", "d", 2, True, 0.5, 3, "s") for r in ROWS], SCHEMA)


def test_stages_on_odd_rows(spark, frame, tmp_path):
    want = {"toxicity": [1, 2, 3, 4, 4, 5, 6, 7, None], "exact_dedup": [2, 3, 5, 6, 7, None], "near_dedup": [2, 3, 5, 7, None], "decontamination": [2, 3, 5, 7, None]}
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(frame.columns)] == frame.columns
        if name in want:
            assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(map(str, want[name])), name
    assert all(r.taken_ > 0 and r.taken == 3 for r in docs.collect())


def test_stages_on_an_empty_table(spark, frame):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame.limit(0), SF)
        assert out.isEmpty() and out.columns[: len(frame.columns)] == frame.columns


def test_repeated_rows_are_screened_alike(spark, frame):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words here") for i in range(40)] + [(90, "vile words here")] * 3, "doc_id long, text string")
    assert sorted(r.doc_id for r in toxicity.screen(docs, labels).collect()) == [i for i in range(40) if i % 2 == 0]


def test_chat_with_long_texts_and_repeated_rows(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", "yo"), (2, 0, "user", LONG), (3, 0, "user", "hi"), (3, 0, "user", "hi")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 3} and LONG in got[1].chat and got[3].n_turns == 2


def test_lines_of_long_texts_and_clashing_columns(spark):
    lines = [" ".join(f"t{i}x{j}" for j in range(40)) for i in range(400)]
    near = [x.replace("x3 ", "changed ") for x in lines]
    docs = spark.createDataFrame([(1, "\n".join(lines), 7, "c"), (2, "\n".join(near + ["a line of its own"]), 8, "d")], "doc_id long, text string, cid int, words string")
    got = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].text) == (0, 400, "a line of its own")
