"""The divergence audit against a plain computation, with blocks and chunks small enough to make many tiles."""

import re
from collections import Counter

import pyarrow as pa
import pytest

from kilngraph.llm import source_divergence as D

KIND = "doc_id long, text string, lang string, source string, term string, chunk int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, most=10):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(FOLD)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t in df if df[t] >= least)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            counts[s].update({t: n for t, n in c.items() if t in set(kept)})
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in counts.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in shares.items():
            pairs = [(sum(f(p[t], shares[o][t]) for t in kept), o) for o in shares if o != s]
            terms = [(f(p[t], q[t]), t) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 3) for i, r in enumerate(rows)], KIND).repartition(3)


def test_many_tiles(spark):
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉPSILON", "zeta", "日本語", "a1b", "x", "rare%d"]
    rows = []
    for i in range(240):
        text = " ".join(words[(i * j + j * j) % 10] if words[(i * j + j * j) % 10] != "rare%d" else f"rare{'abcdefghij'[i % 10]}" for j in range(i % 17))
        rows.append((text, ("en", "fr", None)[i % 3], f"s{i * 7 % 11}" if i % 13 else None))
    rows += [("", "de", "only"), (None, "xx", "a"), ("word", "xx", "b")]
    got = D.audit(table(spark, rows), block_groups=2, chunk_terms=3)
    assert sorted(map(tuple, got.collect())) == plain(rows)
    got = D.audit(table(spark, rows), least_docs=1, most_terms=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 1, 3)


def test_one_long_text_among_repeated_rows(spark):
    rows = [("same words " * 3, "en", "a")] * 12 + [("same other " * 50_000, "en", "b")]
    assert sorted(map(tuple, D.audit(table(spark, rows)).collect())) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty(spark, rows):
    assert sorted(map(tuple, D.audit(table(spark, rows)).collect())) == plain(rows)


def test_terms_end_with_their_text():
    texts = ["ab", "cd, EF", "", "9x9y", None, "é ß"]
    number, terms = D.term_array(pa.array(texts).fill_null("").slice(0))
    assert list(zip(number.tolist(), terms.to_pylist(), strict=True)) == [(i, t) for i, x in enumerate(texts) for t in TERM.findall((x or "").translate(FOLD))]
    number, terms = D.term_array(pa.array(["zz", *texts[:2]]).slice(1))
    assert terms.to_pylist() == ["ab", "cd", "ef"] and number.tolist() == [0, 1, 1]


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (3, 7, 5), (10**12, 3 * 10**12, 10**6), (999_999_999_999, 10**15, 7)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select(D.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
