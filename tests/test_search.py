"""Substring index, dictionary automaton, vector index: equal to brute force, and what they spare."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilngraph.operators import linking, mentions
from kilngraph.operators.substrings import SubstringIndex

# --- substrings ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    return [("".join(draw.choices("abcd水库河", k=draw.randint(1, 14)))) for _ in range(400)] + ["", None, "x", "xy", "😀水", "a%b_c"]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "abcd", "x")], "id long, name string, gram string")
    return SubstringIndex.build(rows.repartition(3), str(tmp_path_factory.mktemp("grams") / "i"))


def test_substrings_equal_contains(spark, texts, index):
    draw = random.Random(9)
    words = ["", None, "x", "y", "xy", "😀", "😀水", "a%b", "_", "水库河", "zzzz", "abcdabcdabcdabcdabcd"]
    words += [t[a : a + draw.randint(1, 6)] for t in texts[:60] if t for a in [draw.randrange(len(t))]]
    found = index.find(spark.createDataFrame([(w,) for w in words * 2], "keyword string")).collect()
    want = sorted((w, i, t) for w in {x for x in words if x} for i, t in enumerate(texts) if t and w in t)
    assert sorted((r.keyword, r.key, r.text) for r in found) == want
    assert sorted(r.key for r in index.search("水库").collect()) == [i for i, t in enumerate(texts) if t and "水库" in t]


def test_a_rare_keyword_reads_few_files_and_rows(spark, index):
    rare = spark.createDataFrame([("😀水",)], "keyword string")
    assert index.candidates(rare).count() == 1
    assert len(index._of("postings", rare.selectExpr("keyword as gram")).inputFiles()) >= 1
    assert index._of("postings", rare.selectExpr("keyword as gram")).count() <= 3


# --- names in texts --------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.lists(st.text("abc", min_size=1, max_size=4), max_size=5))
def test_automaton_finds_every_occurrence(text, names):
    want = sorted({(i, i + len(n)) for n in names for i in range(len(text)) if text.startswith(n, i)}, key=lambda s: (s[0], -s[1]))
    assert mentions.occurrences(mentions.automaton(list(dict.fromkeys(names))), text) == want


@pytest.mark.parametrize("most", [mentions.MOST_NAMES, 3])
def test_mentions_in_one_pass_or_by_parts(spark, most):
    names = ["甲水库", "水库", "甲", "库水", "乙站", "乙站", "", None, "aa", "a😀"]
    texts = [(1, "甲水库水站与乙站"), (2, "aaa😀甲"), (3, ""), (4, None), (1, "甲水库水站与乙站"), (None, "无")]
    frames = spark.createDataFrame([(*t, "x") for t in texts], "i long, text string, name string").repartition(2), spark.createDataFrame([(n,) for n in names], "name string")
    best = sorted(map(str, mentions.longest(*frames, ["i"], most_names=most).collect()))
    assert best == sorted(f"Row(i={i}, mention={m!r})" for i, m in [(1, "甲水库"), (1, "甲水库"), (2, "aa"), (3, None), (4, None), (None, None)])
    got = sorted((r.i, r.start, r.end, r.name) for r in mentions.mentions(*frames, ["i"], most_names=most).collect())
    assert got == [(1, 0, 3, "甲水库"), (1, 0, 3, "甲水库"), (1, 6, 8, "乙站"), (1, 6, 8, "乙站"), (2, 0, 2, "aa"), (2, 2, 4, "a😀"), (2, 4, 5, "甲")]
    assert mentions.longest(frames[0], frames[1].where("false"), ["i"]).where("mention is not null").isEmpty()


def test_slots_of_many_questions(spark):
    asked = spark.createDataFrame([(1, "2020年甲水库的供水量，2019与12020、2020？"), (2, "？"), (3, None)], "q long, text string")
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "name string")
    got = {r.q: (r.entity, r.indicator, r.years) for r in mentions.slots(asked, words("甲水库", "水库"), words("供水", "供水量"), ["q"]).collect()}
    assert got == {1: ("甲水库", "供水量", [2019, 2020]), 2: (None, None, []), 3: (None, None, None)}


# --- vectors ---------------------------------------------------------------------------------------------------------


def brute(vectors, anchors):
    out = []
    unit = lambda v: [x / np.sqrt(sum(float(y) * float(y) for y in v)) for x in map(float, v)] if v is not None and all(x is not None for x in v) and any(v) else None
    named = sorted((n, unit(v)) for n, v in anchors if unit(v) is not None)
    for i, v in vectors:
        u, best = unit(v), (None, -2.0)
        for n, a in named:
            if u is not None and len(u) == len(a):
                score = 0.0
                for x, y in zip(u, a, strict=True):
                    score += x * y
                best = (n, score) if score > best[1] else best
        out.append((i, best[0], round(float(best[1]), 9)))
    return sorted(map(str, out))


def search(spark, vectors, anchors):
    index = linking.VectorIndex(spark.createDataFrame(anchors, "name string, v array<float>").repartition(3), "name", "v")
    got = index.search(spark.createDataFrame(vectors, "i long, v array<float>").repartition(3), "i", "v").collect()
    return index, sorted(str((r.i, r.best_name, round(r.similarity, 9))) for r in got)


def f32(values):
    return [float(x) for x in np.float32(values)]


def test_vector_index_spares_pairs_of_clustered_vectors(spark, monkeypatch):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(25, 16))
    anchors = [(f"a{i:03d}", f32(centres[i % 25] + draw.normal(scale=0.05, size=16))) for i in range(500)]
    vectors = [(i, f32(centres[i % 25] + draw.normal(scale=0.05, size=16))) for i in range(400)]
    monkeypatch.setattr(linking, "PAGE_ANCHORS", 7)
    monkeypatch.setattr(linking, "SLICE_VECTORS", 9)
    index, got = search(spark, vectors, anchors)
    assert got == brute(vectors, anchors)
    assert index.compared < 0.2 * len(vectors) * len(anchors)


def test_vector_index_of_scattered_tied_and_odd_vectors(spark):
    draw = np.random.default_rng(8)
    anchors = [(f"a{i}", f32(draw.normal(size=5))) for i in range(40)] + [("b", f32([1, 0, 0, 0, 0])), ("a", f32([2, 0, 0, 0, 0])), ("zero", [0.0] * 5), ("none", None)]
    vectors = [(i, f32(draw.normal(size=5))) for i in range(60)] + [(90, f32([3, 0, 0, 0, 0])), (90, f32([3, 0, 0, 0, 0])), (91, [0.0] * 5), (92, None), (93, [1.0, None, 0.0, 0.0, 0.0]), (94, [1.0, 2.0])]
    assert search(spark, vectors, anchors)[1] == brute(vectors, anchors)
    assert search(spark, vectors[:3], [("none", None)])[1] == sorted(str((i, None, -2.0)) for i, _ in vectors[:3])
    assert search(spark, [], anchors)[1] == []
