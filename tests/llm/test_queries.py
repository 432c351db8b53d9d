"""The opN queries against SQL or brute force on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from kilngraph.llm import decontaminate
from kilngraph.llm.oracles import oracle_sql
from kilngraph.llm.queries import queries
from tests.llm.test_edge_cases import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, duck, name):
    frame, want = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in frame.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_minhash_against_brute_force(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = queries()["op1_minhash"](spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 2)


def test_model_beats_its_base_on_held_out(spark):
    held = queries()["op2_language_model"](spark, SF).where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "mixing":
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        if name == "exact_dedup":
            groups = {}
            for r in before.values():
                groups.setdefault((r.text or "").encode().lower(), []).append(r.doc_id)
            assert set(after) == {max(g) for g in groups.values()}
        if name == "near_dedup":
            comps = brute_components([(r.doc_id, r.text) for r in before.values()], 5)
            assert set(map(str, after)) == {i for i, n, c in comps if i == c or n == 0}
        if name == "decontamination":
            marks = decontaminate.brute_force([r.text for r in before.values()], items)
            assert set(after) == {i for i, (n, hit, *_) in zip(before, marks, strict=True) if not (hit and 20 * hit >= n)}
        if name == "mixing":
            assert all(0 < r.taken <= 2 * r.size for r in after.values())
