"""op5_line_dedup: what the driver holds, and classes whose places tie."""

import random

from pyspark.sql import functions as F

from kilngraph.llm import line_dedup
from tests.llm.test_edge_cases import brute_lines


def test_rarity_table_is_a_small_part_of_the_plan(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.concat(F.lit("w"), (F.col("id") * 400 + i).cast("string")))
    docs = spark.range(750).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    classes = line_dedup._classes(docs, "doc_id", "text")
    index = line_dedup._prefixes(classes, spark.createDataFrame([], "done long"))
    assert len(index._jdf.queryExecution().optimizedPlan().toString()) < 600_000
    assert index.count() > 0


def test_ids_of_any_type_and_blanks_of_any_kind(spark):
    draw = random.Random(5)
    vocabulary = [f"v{i}" for i in range(14)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(draw.randint(1, 3)):
            words = draw.sample(vocabulary, draw.randint(1, 11))
            lines.append("".join(draw.choice(["", " ", "\t"]) + w + draw.choice([" ", "  ", "\t", "\r", "\x0b\x0c"]) for w in words))
        rows.append((i + 100, "\n".join(lines)))
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    for docs, ids in ((whole, lambda i: i), (whole.withColumn("doc_id", F.col("doc_id").cast("string")), str), (whole.withColumn("doc_id", F.col("doc_id").cast("double")), float)):
        got = line_dedup.deduplicate(docs).collect()
        assert sorted(str((r.doc_id, r.text)) for r in got) == brute_lines([(ids(i), text) for i, text in rows])


def test_few_pairs_of_unlike_long_lines_are_verified(spark, monkeypatch):
    draw = random.Random(7)
    lines = [draw.sample(range(4000), 140) for _ in range(160)]
    lines += [[*line[:133], *range(9000 + 7 * i, 9007 + 7 * i)] for i, line in enumerate(lines[:20])]
    rows = [(i, " ".join(f"w{w}" for w in line)) for i, line in enumerate(lines)]
    pairs, write = [], line_dedup.materialise

    def counted(df, name, **more):
        out = write(df, name, **more)
        if name == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    # No near copies are settled first, so that all pairs meet under their words.
    monkeypatch.setattr(line_dedup, "_near_copies", lambda classes: spark.createDataFrame([], "done long"))
    monkeypatch.setattr(line_dedup, "_if_few", lambda df: df)
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == brute_lines(rows)
    assert sum(r.n_removed for r in got) == 20
    assert len(pairs) == 1 and 20 <= pairs[0] < 100
