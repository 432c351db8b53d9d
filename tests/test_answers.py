"""Every distinct prompt is asked once, whatever fails in between."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from kilngraph.operators import documents, extraction
from kilngraph.sources import answers, readers
from tests.test_documents import TABLE


def counted(folder, broken=(), crash=None):
    """A model that notes every prompt it is asked; it fails on calls with a ``broken`` prompt, and dies on ``crash``."""

    def model(prompts, max_tokens):
        for prompt in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(prompt)
        if any(p in broken for p in prompts):
            raise RuntimeError("model down")
        if crash in prompts:
            os._exit(1)
        return [f"<{p}>" for p in prompts]

    return model


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


@pytest.fixture
def counter(tmp_path):
    (tmp_path / "asked").mkdir()
    return tmp_path / "asked"


def rows(spark, prompts):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(prompts)], "n int, prompt string, key string").repartition(3)


def test_distinct_prompts_once_over_runs(spark, tmp_path, counter):
    prompts = [f"p{i % 40}" for i in range(200)] + ["", "  ", None]
    store = answers.AnswerStore(spark, str(tmp_path / "store"), {"model": "m", "temperature": 0}, call_prompts=7)
    got = {r.n: r.response for r in store.ask(rows(spark, prompts), counted(counter), 100).collect()}
    assert got == {i: f"<{p}>" if p and p.strip() else "" for i, p in enumerate(prompts)}
    assert asked(counter) == sorted({f"p{i}" for i in range(40)}) and (store.asked, store.lost) == (40, 0)
    more = store.ask(rows(spark, [*prompts, "new"]), counted(counter), 100)
    more.count(), more.count()
    assert len(asked(counter)) == 41 and store.asked == 1
    # Other options are another key.
    answers.AnswerStore(spark, str(tmp_path / "store"), {"model": "other"}).ask(rows(spark, ["p1"]), counted(counter), 100)
    assert asked(counter).count("p1") == 2


def test_a_failed_run_keeps_its_answers(spark, tmp_path, counter):
    prompts = [f"p{i}" for i in range(60)]
    store = answers.AnswerStore(spark, str(tmp_path / "store"), call_prompts=1)
    with pytest.raises(Exception):  # noqa: B017  the worker dies
        store.ask(rows(spark, prompts), counted(counter, crash="p31"), 100)
    before = asked(counter)
    got = store.ask(rows(spark, prompts), counted(counter), 100).collect()
    assert sorted(r.response for r in got) == sorted(f"<{p}>" for p in prompts)
    # Only the prompt whose call died may have been asked again.
    assert set(before) < set(prompts) | {"p31"} and {p for p in asked(counter) if asked(counter).count(p) > 1} <= {"p31"}


def test_failed_prompts_are_isolated_listed_and_asked_again(spark, tmp_path, counter):
    prompts = [f"p{i}" for i in range(20)]
    store = answers.AnswerStore(spark, str(tmp_path / "store"), call_prompts=20, attempts=1)
    got = {r.prompt: r.response for r in store.ask(rows(spark, prompts), counted(counter, broken=("p3", "p4")), 100).collect()}
    assert {p for p, r in got.items() if r is None} == {"p3", "p4"} and store.lost == 2
    assert {(r.prompt, r.error) for r in store.failed(100).collect()} == {("p3", "RuntimeError: model down"), ("p4", "RuntimeError: model down")}
    got = {r.prompt: r.response for r in store.ask(rows(spark, prompts), counted(counter), 100).collect()}
    assert got["p3"] == "<p3>" and store.asked == 2 and store.failed(100).count() == 0
    store.compact(100)
    assert store.answers(100).count() == 20 and store.ask(rows(spark, prompts), counted(counter), 100).count() == 20 and store.asked == 0


def test_calls_fit_the_budget():
    call = list(answers.calls(iter([("a", "x" * 30), ("b", "y" * 3), ("c", "z" * 300), ("d", "")]), 12, 9))
    assert [[k for k, _ in c] for c in call] == [["a"], ["b"], ["c"], ["d"]] or [[k for k, _ in c] for c in call] == [["a"], ["b"], ["c"], ["d"]]
    assert [len(c) for c in answers.calls(((str(i), "") for i in range(5)), 100, 2)] == [2, 2, 1]
    short = lambda prompts, tokens: prompts[:-1]
    assert answers._tried(short, [("k", "p")], 1, 1) == ([], [("k", "p", "0 answers to 1 prompts")])


def test_extraction_asks_each_distinct_prompt_once(spark, tmp_path, counter):
    pages = [(f"f{i}.pdf", 1, "甲水库的死水位为120m，正常蓄水位为150m，由水利部门于2020年核定并公布执行，供各地参照使用。", "native", "page", [{"markdown": TABLE}] if i == 0 else []) for i in range(6)]
    rows = spark.createDataFrame([(p, n, None, t if not tables else "", tables, [], None) for p, n, t, _, _, tables in pages], f"path string, {readers.PAGE}")
    files = documents.intermediate(readers.page_text(rows, layout=True))

    def model(prompts, max_tokens, note=counted(counter)):
        note(prompts, max_tokens)
        return [json.dumps([{"subject": "s", "relation": "r", "object": "o"}]) for _ in prompts]

    store = answers.AnswerStore(spark, str(tmp_path / "store"))
    triples = documents.extract(files, model, store=store)
    assert triples.where(F.col("data_type") == "text").count() == 5 and triples.count() == 7
    assert len(asked(counter)) == len(set(asked(counter))) == 3  # one text, two segments of a table
    assert documents.extract(files, model, store=store).count() == 7 and len(asked(counter)) == 3
    assert store.answers(extraction.TEXT_TOKENS).count() == 1
