"""Suffix-array search against plain comparison: hits, items and longest verbatim matches."""

import random

import numpy as np
import pytest

from kilngraph.llm import decontaminate


def test_abutting_items_are_two_matches():
    first, second = " ".join(f"a{i}" for i in range(13)), " ".join(f"b{i}" for i in range(13))
    block = decontaminate.Benchmark([("1", first.encode()), ("2", second.encode())])
    ((mask, items, longest, at, item, item_at),) = block.search([f"x {first} {second} y".encode()])
    assert (mask.sum(), items, longest, at, item, item_at) == (26, ["1", "2"], 13, 1, "1", 0)


def test_a_match_may_be_longer_than_any_block_name():
    text = " ".join(f"w{i}" for i in range(90))
    block = decontaminate.Benchmark([("1", f"head {text} tail".encode()), ("2", " ".join(f"w{i}" for i in range(40)).encode())])
    ((mask, items, longest, at, item, item_at),) = block.search([f"one two {text} three".encode()])
    assert (mask.sum(), items, longest, at, item, item_at) == (90, ["1", "2"], 90, 2, "1", 1)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 13])
def test_random_texts_against_brute_force(window):
    rng = random.Random(7 * window)
    text = lambda n, v: " ".join(f"t{rng.randrange(v)}" for _ in range(n))
    for v in (2, 3, 12):
        items = [(str(i % 9), text(rng.choice([0, 1, 2, 4, 9, 20, 40]), v)) for i in range(14)] + [(None, text(6, v)), ("same", "t0 " * 18)]
        texts = [text(rng.choice([0, 1, 5, 30, 80]), v + 1) for _ in range(14)] + [items[5][1] + " " + items[6][1], "t0 " * 40]
        want = decontaminate.brute_force(texts, items, window)
        block = decontaminate.Benchmark([(i, t.encode()) for i, t in items], window)
        got = block.search([t.encode() for t in texts])
        for (n, hits, many, _), t, (mask, found, longest, at, item, item_at) in zip(want, texts, got, strict=True):
            assert (len(mask), int(mask.sum()), len(found)) == (n, hits, many)
            assert longest == decontaminate.brute_longest(t, items)
            if longest:
                own = [t2.split() for i, t2 in items if i == item]
                assert any(o[item_at : item_at + longest] == t.split()[at : at + longest] for o in own)


def test_a_million_windows(spark):
    """A benchmark of a million windows is searched in blocks, vectorised; every planted passage is found."""
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(60_000)}" for _ in range(212))) for i in range(5000)]
    docs = [(i, f"lead {items[i * 7][1][:600]} and more {i}") for i in range(300)] + [(1000 + i, " ".join(f"v{rng.randrange(60_000)}" for _ in range(200))) for i in range(300)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.contaminated == (r.doc_id < 1000) and (r.doc_id >= 1000 or (r.items == [str(r.doc_id * 7)] and r.longest_match > 80 and r.longest_match_at == 1)) for r in got)


@pytest.mark.parametrize("bits", [3, 9, 31])
def test_suffixes_are_in_full_order(bits):
    rng = random.Random(bits)
    for n in (0, 1, 7, 60, 300):
        tokens = [rng.choice([0, 1, 1, 2, 5]) for _ in range(n)] + [1, 2] * 40 + [0] + [1, 2] * 40 + [0, 0]
        suffix = lambda i, tokens=tokens: tuple(tokens[i : next(k for k in range(i, len(tokens)) if tokens[k] == 0)])
        array = decontaminate.SuffixArray(np.array(tokens), bits)
        order = array.order.tolist()
        assert sorted(order) == [i for i, t in enumerate(tokens) if t] and all(suffix(a) <= suffix(b) for a, b in zip(order, order[1:], strict=False))
        other = decontaminate.SuffixArray(np.array([rng.choice([0, 1, 2, 3]) for _ in range(40)] + [1, 2, 1, 2, 1, 2, 0]), bits)
        at = np.flatnonzero(other.tokens)
        theirs = [tuple(other.tokens[i : i + other.ahead[i]].tolist()) for i in at]
        assert array.places(other, at).tolist() == [sum(suffix(i) < q for i in order) for q in theirs]
        depth = np.array([rng.randint(1, len(q)) for q in theirs])
        low, high = array.ranges(other, at, depth)
        for q, d, a, b in zip(theirs, depth.tolist(), low.tolist(), high.tolist(), strict=True):
            assert set(order[a:b]) == {i for i in order if suffix(i)[:d] == q[:d]}


def test_blocks_give_what_one_block_gives(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"t{rng.randrange(40)}" for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 20, 60]))) for i in range(40)] + [(None, text(20))]
    docs = [(i, f"{text(30)} {items[i][1]} {text(rng.choice([0, 200]))}", "x") for i in range(35)] + [(99, None, "y")]
    frames = spark.createDataFrame(docs, "doc_id long, text string, items string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontaminate.contamination(*frames).collect()))
    many = sorted(map(str, decontaminate.contamination(*frames, block_bytes=700, shard_bytes=900).collect()))
    cut = lambda rows: [r.split(", longest_item=")[0] for r in rows]  # noqa: E731  an equally long match may be another block's
    assert cut(one) == cut(many)
    clean = {r.doc_id for r in decontaminate.contamination(*frames).where("not contaminated").collect()}
    for options in ({}, {"block_bytes": 700, "shard_bytes": 900}):
        kept = decontaminate.decontaminate(*frames, **options)
        assert kept.columns == ["doc_id", "text", "items"] and {r.doc_id for r in kept.collect()} == clean and 0 < len(clean) < len(docs)
