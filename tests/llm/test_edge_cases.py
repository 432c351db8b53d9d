"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kilngraph.llm import chat, decontaminate, exact_dedup, language_model, licenses, line_dedup, mixing, near_dedup, toxicity, warc

LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(40_000))
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30 ", "changed ")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, id int, row long, n long, taken string"
ROWS = [
    (1, "Same Text here", "en", "b", 1), (2, "same text HERE", "en", "b", 1), (3, None, "en", None, 0), (4, "", None, "a", 0), (5, "  \n\t ", "en", "a", 5), (6, LONG, "en", "b", 9), (7, BASE, "en", "c", 9), (8, NEAR, "en", "c", 9),
    (9, BASE, "en", None, 9), (9, BASE, "en", None, 9), (None, "orphan text without id", None, None, None), (10, "ÀÉ Straße É", "de", "é", 3), (11, "àé straße É", "de", "é", 3), (12, "one", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "y") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return (text or "").encode().lower()


def test_exact_dedup(docs, none):
    got = exact_dedup.assign(docs, k=3).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for r in ROWS:
        groups.setdefault(hashlib.sha256(fold(r[1])).hexdigest(), []).append(r[0])
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert sorted(str(r.doc_id) for r in got if r.kept) == sorted(str(max((i for i in ids if i is not None), default=None)) for ids in groups.values())
    kept = exact_dedup.deduplicate(docs, k=3)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.assign(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def test_misra_gries_finds_every_frequent_key():
    keys = [b"hot"] * 400 + [f"{i}".encode() for i in range(500)]
    summary = exact_dedup.MisraGries(8)
    for i in range(0, len(keys), 50):
        batch = keys[i::18]
        summary.add(batch, [1] * len(batch))
    assert b"hot" in summary.counters and len(summary.counters) <= 8


def brute_components(rows, k, hundredths=80):
    sets = []
    for _, text, *_ in rows:
        w = fold(text).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    ids = {c: min((r[0] for r, d in zip(rows, comp, strict=True) if d == c and r[0] is not None), default=None) for c in comp}
    return sorted((str(r[0]), len(s), str(ids[c])) for r, s, c in zip(rows, sets, comp, strict=True))


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, none, k):
    got = near_dedup.assign(docs, shingle_words=k).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(ROWS, k)
    assert near_dedup.assign(none).count() == 0


def test_near_dedup_keeps_one_of_each_group(docs, none):
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 1 and 2 are equal, 7, 8, 9 and 9 are near copies, 10 and 11 differ beyond A-Z; texts without words all stay.
    assert ids == sorted(map(str, [1, 3, 4, 5, 6, 7, None, 10, 11, 12]))
    assert near_dedup.deduplicate(none).count() == 0


def test_near_dedup_searches_crowded_buckets(spark):
    """400 texts of similarity 0.7974 by a common core crowd the buckets; twenty pairs among them reach 0.8003."""
    core, rows, want = [f"core{i}" for i in range(1000)], [], {}
    for i in range(400):
        shared = [f"pair{i // 2}x{j}" for j in range(2)] if i < 40 else []
        own = [f"own{i}x{j}" for j in range(127 - len(shared))]
        rows.append((i, " ".join(core + shared + own)))
        want[i] = i - i % 2 if i < 40 else i
    got = near_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=1).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_sketches_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(2))
    ra, rb, rab = near_dedup.registers([a, b, np.unique(np.concatenate([a, b]))])
    assert (np.maximum(ra, rb) == rab).all()
    same = np.array([ra])
    assert near_dedup.worth_verifying(same, same, np.array([len(a)]), np.array([len(a)]), 0.8)[0]
    assert not near_dedup.worth_verifying(np.array([ra]), np.array([rb]), np.array([len(a)]), np.array([len(b)]), 0.8)[0]


def test_language_model(docs, none):
    import math
    from collections import Counter

    got = language_model.score_documents(docs, shard_tokens=500, range_keys=50).collect()
    assert len(got) == len(ROWS)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [(i, [*fold(t).split(), None]) for i, t, *_ in ROWS]
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert language_model.score_documents(none).count() == 0


def test_em_prefers_the_better_estimate():
    import numpy as np

    levels, step = language_model.LEVELS, language_model.STEPS
    cell = ((3 * levels + step + 1) * levels + 4 * step + 1) * levels + 10 * step + 1  # bucket 3, trigram 1/2, bigram 1/16, unigram 2**-10
    weights = language_model.learn_weights(np.array([cell]), np.array([1000]), 10_000)
    assert weights[3, 0] > 0.99 and abs(weights.sum(1) - 1).max() < 1e-9


def test_toxicity(spark, docs, none):
    bad = [(100 + i, f"you are an idiot and a pathetic clown number {i}") for i in range(60)]
    good = [(200 + i, f"the weather in town number {i} is mild and the river is calm") for i in range(300)]
    more = spark.createDataFrame([(*r, "en", "s", 1, 1, "x", 2, 3, 4, "y") for r in bad + good], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(100, 0), (None, 1), (201, None)], "doc_id long, toxic int")
    both = docs.unionByName(more)
    got = {r.doc_id: r for r in toxicity.score_documents(both, labels).collect()}
    assert all(got[i].predicted == 1 for i, _ in bad) and not any(got[i].predicted for i, _ in good)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == got[4].score
    assert got[100].held_out == (zlib.crc32(b"100") % 5 == 0)
    kept = toxicity.screen(both, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {i for i, _ in good} <= ids and not ids & {i for i, _ in bad}
    assert toxicity.score_documents(none, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}


def test_isotonic_is_monotone():
    import numpy as np

    x = np.arange(50.0)
    y = (np.sin(x) > 0).astype(float)
    fit = toxicity.Isotonic().fit(x, y)(np.linspace(-5, 60, 200))
    assert (np.diff(fit) >= 0).all() and fit.min() >= 0 and fit.max() <= 1


def brute_lines(rows):
    seen, out = [], []
    keyed = sorted(((i is not None, i or 0), t or "", n) for n, (i, t, *_) in enumerate(rows))
    for _, text, n in keyed:
        kept = []
        for line in text.split("\n"):
            words = {w for w in __import__("re").split("[ \t-\r]+", line.lower()) if w}
            hit = any(5 * len(words & s) >= 4 * len(words | s) for s in seen) if words else False
            if not hit:
                kept.append(line)
            if words:
                seen.append(words)
        out.append((rows[n][0], "\n".join(kept)))
    return sorted(map(str, out))


def test_line_dedup(spark, docs, none):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"{line}\n\nShort"), (2, f"{line} lambda\nshort\nother"), (3, None), (4, "\n\n"), (None, "null first\nx"), (5, "null first\nNULL FIRST"), (6, "a b\nb a\na c")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n int")
    got = line_dedup.deduplicate(frame).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == brute_lines(rows)
    assert all(r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.text or r.n_removed < r.n_lines else 0) for r in got)
    assert line_dedup.deduplicate(docs).count() == len(ROWS) and line_dedup.deduplicate(none).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>same</p>", 0), (3, None, "<p>same</p>", 0), (2, "u", "<p>same</p>", 0), (4, "u", None, 0), (5, "u", "", 0), (6, "ü", "é" * 200_000, 0), (None, "u", "alone", 0), (7, "u", "twice", 0), (7, "u", "twice", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    for zip64 in (False, True):
        manifest = warc.write_archives(pages, member_bytes=300, archive_bytes=600, force_zip64=zip64)
        got = warc.read_archives(manifest, with_payload=True).collect()
        seen = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got)
        assert seen == sorted([("1", "revisit", "3", 11), ("2", "revisit", "3", 11), ("3", "response", "None", 11), ("4", "revisit", "5", 0), ("5", "response", "None", 0), ("6", "response", "None", 400_000), ("None", "response", "None", 5), ("7", "response", "None", 5), ("7", "revisit", "7", 5)])
        assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {"<p>same</p>", "", "é" * 200_000, "alone", "twice"}
    few = warc.read_archives(warc.write_archives(pages, least_bytes=11)).collect()
    assert sum(r.record_type == "revisit" for r in few) == 2
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_text_ids(spark):
    ids = ["a:b", "c:b", "null", None, "", "<x>", "50%", "%3A", "two\r\nlines", "ü/é", "urn:page:1"]
    pages = spark.createDataFrame([(i, "u", "same" if k % 2 else f"own {k}", "x") for k, i in enumerate(ids)], "page_id string, url string, html string, rows string")
    got = warc.archive_round_trip(pages).collect()
    top = max((i for k, i in enumerate(ids) if k % 2 and i is not None), key=lambda i: i.encode())
    want = [(i, "revisit" if k % 2 and i != top else "response", top if k % 2 and i != top else None) for k, i in enumerate(ids)]
    assert sorted(map(str, ((r.page_id, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))


def test_warc_frequent_payloads_are_joined_map_side(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY_PAYLOADS", 3)
    rows = [(i, "u", "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"own {i}") for i in range(90)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    last = {}
    for i, _, html in rows:
        last[html] = max(last.get(html, i), i)
    assert sorted((r.page_id, r.record_type, r.refers_to or -1) for r in got) == sorted((i, "response" if last[h] == i else "revisit", -1 if last[h] == i else last[h]) for i, _, h in rows)


def test_zip_is_readable_by_others(tmp_path):
    import io
    import zipfile

    for force in (False, True):
        buffer = io.BytesIO()
        writer = warc.ZipWriter(buffer, force)
        writer.add("a.txt", b"hello")
        writer.add("é/b.bin", bytes(1000))
        writer.close()
        with zipfile.ZipFile(io.BytesIO(buffer.getvalue())) as z:
            assert z.testzip() is None and z.read("a.txt") == b"hello" and z.namelist() == ["a.txt", "é/b.bin"]

    class Memory:
        def __init__(self, data):
            self.data, self.size = data, len(data)

        def read(self, at, length):
            return self.data[at : at + length]

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x", b"abc")
        z.comment = b"note with PK\x05\x06 inside"
    source = Memory(buffer.getvalue())
    reader = warc.ZipReader(source)
    assert source.read(reader.data_at(reader.members["x"]), 3) == b"abc"


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (4, 1, None, "x"), (5, 0, "user", ""), (6, None, "user", "hi"), (6, 5, "assistant", "no"), (None, 0, "user", "lone"), (7, 0, "us", "erhi")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h1 int")).collect()}
    assert sorted(map(str, got)) == sorted(map(str, [2, 4, 6, None, 7]))
    assert got[2].n_copies == 2 and got[2].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mixture(docs, none, spark):
    got = mixing.mixture(docs, shard_words=5_000).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mixture(docs, shard_words=5_000).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    assert all(r.taken == r.passes * r.size + sum(s["to"] - s["from"] for s in r.extra) for r in got)
    by_source = {}
    sources = {(str(r[0])): r[3] for r in ROWS}
    for r in got:
        s = by_source.setdefault(sources[str(r.doc_id)], [r.target, 0, r.source_size])
        s[1] += r.taken
    for target, taken, size in by_source.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= max(2, 0.02 * target)
    mixed = mixing.blend(docs)
    assert set(docs.columns) <= set(mixed.columns) and mixed.where("taken_ <= 0").count() == 0
    assert mixing.mixture(none).count() == 0 and mixing.blend(none).count() == 0


def test_apportion_equals_highest_quotients():
    votes, seats = [53, 24.5, 23, 0, 23], 17
    plain = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * plain[j] + 1), -j))
        plain[i] += 1
    assert mixing.apportion(votes, seats).tolist() == plain
    assert mixing.apportion([], 5).tolist() == [] and mixing.apportion([0, 0], 5).tolist() == [0, 0]
    assert mixing.targets([100, 10, 10], [3, 1, 2], 180).tolist() == [140, 20, 20]


def test_decontamination(spark, docs, none):
    item = " ".join(f"q{i}" for i in range(20))
    items = [(1, item), (2, "q0 q1 q2"), (3, None), (4, ""), (None, "zz yy"), (5, item), (6, "ÀÉ")]
    rows = [(1, item.upper() + " tail"), (2, "pre " + " ".join(f"q{i}" for i in range(3, 17)) + " post" * 400), (3, "q0, q1! Q2"), (4, None), (5, "zz yy"), (6, "q0 q1"), (7, "ÀÉ àé"), (8, "")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_hit int, items int")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, extra int")
    want = decontaminate.brute_force([t for _, t in rows], [(None if i is None else str(i), t) for i, t in items])
    for block in (decontaminate.BLOCK_BYTES, 60):
        got = {r.doc_id: r for r in decontaminate.contamination(frame, bench, block_bytes=block, shard_bytes=180).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) for i, _ in rows] == want
        assert got[1].contaminated and got[1].longest_match == 20 and got[1].longest_match_at == 0 and not got[2].contaminated
        kept = decontaminate.decontaminate(frame, bench, block_bytes=block)
        assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows if not got[i].contaminated]
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_licenses(spark, docs, none):
    text = "Intro é.\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT licence!\nend Licensed under CC BY-NC 4.0"
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, text), (51, text), (52, "the terms of the license")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.first_word, r.license, r.matched_text) for r in licenses.scan(frame).collect())
    assert [(g[0], g[2]) for g in got] == [(i, n) for i in (50, 51) for n in ("GPL-3.0", "MIT", "CC-BY-NC")]
    for r in licenses.scan(frame).collect():
        assert text[r.start_char : r.end_char] == r.matched_text and 0.8 <= r.coverage <= 1
    assert licenses.scan(none).count() == 0


