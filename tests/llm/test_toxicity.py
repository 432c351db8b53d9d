"""The learned lexicon against plain counting, scores against the model applied row by row, and held-out recall."""

import math

import numpy as np

from kilngraph.llm import toxicity
from kilngraph.llm.storage import table

SF = "/root/testdata/sf0.1"


def test_lexicon_equals_plain_counting(spark):
    texts = [(f"plain words number{i % 7} venom{i % 3} {'extra' * (i % 2)}", i % toxicity.CROSS, float(i % 4 == 0)) for i in range(80)]
    texts += [(f"vile{'abc'[i % 3]}x plain", i % toxicity.CROSS, 1.0) for i in range(12)] + [(None, 0, 0.0), ("", 1, 1.0)]
    got = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, cross int, label double")).odds
    sets = [({e for w in (t or "").encode().split() for e in toxicity.entries(w)}, c, y) for t, c, y in texts]
    want = {}
    for entry in {e for s, _, _ in sets for e in s}:
        weights = []
        for left in range(toxicity.CROSS + 1):
            rest = [(entry in s, y) for s, c, y in sets if c != left]
            t, c = (sum(has and y == k for has, y in rest) for k in (1.0, 0.0))
            odds = math.log((t + 0.5) / (sum(y == 1.0 for _, y in rest) + 1)) - math.log((c + 0.5) / (sum(y == 0.0 for _, y in rest) + 1))
            weights.append(odds if t >= toxicity.LEAST_TOXIC and odds >= toxicity.LEAST_ODDS else 0.0)
        if weights[-1] > 0:
            want[entry] = weights
    assert set(got) == set(want) and b"vile-" in got
    assert all(np.allclose(got[e], want[e]) for e in want)


def test_learned_features():
    lexicon = toxicity.Lexicon({b"vile": (0.0,) * 5 + (3.0,), b"ugly-": (2.0,) * 5 + (2.0,)})
    x = dict(zip(toxicity.FEATURES, toxicity.features(b"Vile, vile uglyish words", lexicon), strict=True))
    assert (x["learned_hits"], x["learned_share"], x["learned_weight"], x["learned_best"], x["learned_second"]) == (2.0, 500.0, 2.0, 3.0, 2.0)
    own = dict(zip(toxicity.FEATURES, toxicity.features(b"Vile, vile uglyish words", lexicon, 0), strict=True))
    assert (own["learned_hits"], own["learned_best"]) == (0.0, 2.0)


def test_query_finds_held_out_toxic_texts_of_every_language(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = toxicity.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (clean.score >= 0.5).mean() <= 0.02
    assert (toxic.score > clean.score.quantile(0.9)).mean() >= 0.95
    assert toxic.groupby("lang").predicted.mean().min() >= 0.75
    model = toxicity.train(docs, labels)
    some = scored.orderBy("doc_id").limit(200).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(abs(r.score - model.score([r.text.encode() if r.text is not None else None])[0]) < 1e-12 for r in some)
