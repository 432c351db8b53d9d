"""Vector codes against a plain Lloyd computation in Python's integers, and what the heaps save."""

import hashlib
import math

import numpy as np
import pytest

from kilngraph.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int, part int, ids string"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """vec_id, label, code, error of usable rows (sorted by id), and the digest of the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    whole = lambda v: [math.floor(float(np.float32(x)) * scale) for x in v] + [0] * (width - len(v))
    kept = sorted(((r[0], whole(r[1]), r[2]) for r in kept), key=lambda r: (r[0] is None, r[0], r[1]))
    cut = lambda v, p: v[p * width // parts : (p + 1) * width // parts]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(own(v, p), []).append(cut(v, p))
            for e, group in members.items():
                books[p][e] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    out = []
    for i, v, label in kept:
        code = [own(v, p) for p in range(parts)]
        out.append((i, label, code, sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code))))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], KIND).repartition(3)
    coded, books = V.compress(df, **options)
    want, digest = plain(rows, **options)
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]), str(r[3]))
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(((i, n, c, e if e < 2**63 else None) for i, n, c, e in want), key=key)
    assert books.sha256() == digest
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    got = {r.label: r.label_error for r in V.with_label_error(coded).collect()}
    assert got == {label: n if n < 2**63 else None for label, n in sums.items()}


def test_clustered_and_repeated(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(9, 8))
    rows = [(i, (centres[i % 9] + draw.normal(scale=0.1, size=8)).tolist(), i % 3) for i in range(300)]
    rows += [(i, [0.25] * 8, None) for i in range(300, 340)] + [(5, rows[5][1], 2), (5, [1.0] * 8, 2)]
    check(spark, rows, entries=16)
    check(spark, rows, entries=7, rounds=6)


def test_unusable_short_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, -2.5, 0.125, 3.0, 9.0], 1), (1, [0.5], None), (None, [-0.001, 7.0], 1), (2, [], 4), (4, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [-inf], 1)]
    check(spark, rows)
    check(spark, rows[:1])


def test_numbers_beyond_doubles(spark):
    rows = [(i, [float(1e30 * (i % 4)), -3.0 * i, float(2.0**40 + i), 0.5], i % 2) for i in range(12)]
    check(spark, rows, entries=3)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)]])
def test_empty(spark, rows):
    check(spark, rows)


def test_heaps_spare_most_parts():
    draw = np.random.default_rng(1)
    centres = draw.integers(-3000, 3000, (8, 4))
    values = (centres[draw.integers(0, 8, 2000)] + draw.integers(-40, 40, (2000, 4))).astype(np.float64)
    books = [centres + draw.integers(-60, 60, (8, 4))]
    block = V.Block.__new__(V.Block)
    block.size, block.values, block.owners, block.heaps = 2000, values[:, None, :], None, [V.Heaps(8)]
    changed = V.Changes(4)
    block.start(books, changed)
    moved = V._updated(books, {k: v[1] for k, v in changed.of.items()}, {k: v[0] for k, v in changed.of.items()})
    assert block.advance(moved, V._moves(books, moved), V.Changes(4)) < 200
    assert (block.owners[0] == V.distances(values, moved[0]).argmin(1)).all()


def test_digits_and_decoding():
    for x in (0, 5, -5, 2**70 + 3, -(2**90)):
        assert sum(d << (V.DIGIT * i) for i, d in enumerate(V.to_digits(x, 4))) == x
    books = V.Codebooks([np.array([[1024, -1024]]), np.array([[0, 512], [3, 4]])])
    assert books.decode([0, 0]) == [1025 / 1024 - 0.5 / 1024, -1 + 0.5 / 1024, 0.5 / 1024, 0.5 + 0.5 / 1024]
