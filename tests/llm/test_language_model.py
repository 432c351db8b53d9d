"""Scores of the interpolated model against a plain computation, token by token."""

import math
import random
import zlib
from collections import Counter, defaultdict

from kilngraph.llm import language_model as lm


def plain_scores(docs):
    """doc -> score: the model by dictionaries and loops."""
    train = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 != 1}
    tokens = {i: [*(t or "").lower().split(), "</s>"] for i, t in docs}
    grams = lambda ws: [(a, b, c) for a, b, c in zip(["<s>", "<s>", *ws], ["<s>", *ws], ws, strict=False)]
    count = [Counter(), Counter(), Counter()]
    own = {i: [Counter(), Counter(), Counter()] for i in tokens}
    for i, ws in tokens.items():
        for g in grams(ws):
            for k in range(3):
                own[i][k][g[2 - k :]] += 1
        if i in train:
            for k in range(3):
                count[k].update(own[i][k])
    n, v, starts = sum(count[0].values()), len(count[0]), len(train)

    def parts(g, minus, first, length):
        c = [count[k][g[2 - k :]] - (minus[k][g[2 - k :]] if minus else 0) for k in range(3)]
        less = 1 if minus else 0
        before = starts - less if g[1] == "<s>" else count[0][g[1:2]] - (minus[0][g[1:2]] if minus else 0)
        before2 = starts - less if first else count[1][g[:2]] - (minus[1][g[:2]] if minus else 0)
        total = n - (length if minus else 0)
        est = [c[2] / before2 if before2 > 0 else 0.0, c[1] / before if before > 0 else 0.0, c[0] / total if total > 0 else 0.0]
        power = lambda x: min(int(math.floor(math.log2(max(x, 0) + 1))), lm.CONTEXT_BUCKETS - 1)
        return est, lm.CONTEXT_BUCKETS + power(before2) if before2 > 0 else power(before)

    level = lambda p: 0 if p <= 0 else min(max(round(-math.log2(p) * lm.STEPS), 0), lm.STEPS * lm.OCTAVES - 1) + 1
    cells = defaultdict(Counter)
    for i in train:
        for pos, g in enumerate(grams(tokens[i])):
            est, b = parts(g, own[i], pos == 0, len(tokens[i]))
            cells[b][tuple(map(level, est))] += 1
    weights = {}
    for b, rows in cells.items():
        w = [0.25] * 4
        for _ in range(lm.EM_ROUNDS):
            new = [1e-3] * 4
            for levels, m in rows.items():
                p = [*(2.0 ** (-(x - 1) / lm.STEPS) if x else 0.0 for x in levels), 1 / (v + 1)]
                s = sum(a * c for a, c in zip(p, w, strict=True))
                for k in range(4):
                    new[k] += m * p[k] * w[k] / s
            new = [x / sum(new) for x in new]
            done = max(abs(a - c) for a, c in zip(new, w, strict=True)) < lm.EM_TOLERANCE
            w = new
            if done:
                break
        weights[b] = w
    out = {}
    for i, ws in tokens.items():
        total = 0.0
        for pos, g in enumerate(grams(ws)):
            est, b = parts(g, None, pos == 0, len(ws))
            w = weights.get(b, [0.05, 0.1, 0.8, 0.05])
            total += math.log10(sum(a * c for a, c in zip(w, est, strict=False)) + w[3] / (v + 1))
        out[i] = total
    return out


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 40])]) for _ in range(rng.randrange(0, 30)))) for i in range(90)]
    docs += [(100 + i, docs[i][1]) for i in range(0, 30, 3)] + [(200, None), (201, "")]
    got = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), shard_tokens=150, range_keys=40).collect()
    want = plain_scores(docs)
    assert len(got) == len(docs)
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 * max(1, abs(want[r.doc_id])) for r in got)


def test_a_text_that_occurs_twice_is_likelier_than_one_that_does_not(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60))
    docs = [(i, text()) for i in range(300)]
    twice = [(1000 + i, docs[i][1]) for i in range(0, 300, 10)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_documents(spark.createDataFrame(docs + twice, "doc_id long, text string")).where("held_out").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    twin = lambda i: i - 1000 if i >= 1000 else i + 1000 if i % 10 == 0 else None
    learned = [got[i] for i in got if twin(i) is not None and not held(twin(i))]
    alone = [got[i] for i in got if twin(i) is None]
    assert len(learned) > 3 and sum(learned) / len(learned) > sum(alone) / len(alone) + 0.15
