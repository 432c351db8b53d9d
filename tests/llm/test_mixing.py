"""The mix against a plain computation: targets, block quotas, rings and runs."""

import math
import random

from pyspark.sql import functions as F

from kilngraph.llm import mixing

SEED, SHARD, BLOCK = 7, 400, 16


def quotients(votes, seats):
    """Sainte-Lague by handing out one seat after the other."""
    got = [0] * len(votes)
    for _ in range(seats if sum(votes) > 0 else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def plain_mix(rows, hashes, firsts):
    """rows: (id, text, source); hashes: row -> (key, shard hash); firsts: (rank, shard) -> hash."""
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, target, open_ = 1.5 * sum(size), {}, list(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    positive = [t for t in target.values() if t > 0]
    block = int(max(1, min(BLOCK, min(positive) // mixing.LEAST_BLOCKS))) if positive else 1
    seats = quotients([target[s] for s in sources], round(sum(target.values()) / block))
    out = {}
    for rank, s in enumerate(sources, 1):
        shards = math.ceil(max(1, total[s]) / SHARD)
        rings = {}
        for i, r in enumerate(rows):
            if r[2] == s and size[i]:
                rings.setdefault(hashes[i][1] % shards, []).append(i)
        quota = dict(zip(sorted(rings), quotients([sum(size[i] for i in rings[k]) for k in sorted(rings)], seats[rank - 1]), strict=True))
        for k, members in rings.items():
            members.sort(key=lambda i: (hashes[i][0], rows[i][0] is not None, rows[i][0] or 0, size[i]))
            blocks = math.ceil(sum(size[i] for i in members) / block)
            passes, run = divmod(min(quota[k], 2 * blocks), blocks)
            first, at = firsts(rank, k) % blocks, 0
            chosen = {b % blocks for b in range(first, first + run)}
            for i in members:
                out.setdefault(rows[i][0], []).append(passes * size[i] + sum((at + w) // block in chosen for w in range(size[i])))
                at += size[i]
    for i, r in enumerate(rows):
        if not size[i]:
            out.setdefault(r[0], []).append(0)
    return {i: sorted(v) for i, v in out.items()}, target


def test_mixture_equals_a_plain_computation(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 120]))) if i % 11 else None, rng.choice(["b", "a", "a", "a", "c", None])) for i in range(120)]
    rows += [(500, "x y z " * 7, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("key")).withColumn("shard_hash", F.xxhash64("key")).collect()
    by = {(r.doc_id, r.text): (r.key, r.shard_hash) for r in keyed}
    hashes = [by[r[0], r[1]] for r in rows]
    first = lambda rank, k: spark.range(1).select(F.xxhash64(F.lit(SEED), F.lit(rank).cast("int"), F.lit(k).cast("long"))).first()[0]
    want, target = plain_mix(rows, hashes, first)
    got = mixing.mixture(docs, shard_words=SHARD, block_words=BLOCK, seed=SEED).collect()
    taken = {}
    for r in got:
        taken.setdefault(r.doc_id, []).append(r.taken)
    assert {i: sorted(v) for i, v in taken.items()} == want
    targets = {r[0]: target[r[2]] for r in rows}
    assert all(abs(r.target - targets[r.doc_id]) < 1e-6 for r in got)
    # Repeated rows share out the plan: the blend takes as many words as the mixture.
    blend = mixing.blend(docs.withColumn("taken", F.lit("clash")), shard_words=SHARD, block_words=BLOCK, seed=SEED)
    assert blend.agg(F.sum("taken_")).first()[0] == sum(r.taken for r in got)
    assert blend.columns[:4] == ["doc_id", "text", "source", "taken"]
