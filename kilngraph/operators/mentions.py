"""Dictionary names in texts, by an Aho-Corasick automaton: one pass over the texts for any number of names.

The automaton is built in the worker from at most ``MOST_NAMES`` names, which is all that a task is sent.  Names of a larger
dictionary are found by a join instead, so that texts are not read once per part of it: the pieces of a text that have the
length, the first and the last character of some name are joined with the names.

Defined cases: null and empty names are left out, names that repeat count once; a null text mentions nothing; search is
by code points and minds case; repeated rows each get their result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.lineage import cut
from kilngraph.operators.linking import bounded

#: Names of one automaton.
MOST_NAMES = 200_000


def automaton(names: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for name in names:
        out.add_word(name, name)
    out.make_automaton()
    return out


def occurrences(machine: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    """(start, end) of every occurrence of every name, by start, the longer one first."""
    return sorted(((end + 1 - len(name), end + 1) for end, name in machine.iter(text)), key=lambda s: (s[0], -s[1])) if len(machine) else []


def _finder(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(names)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"start": a, "end": b} for a, b in occurrences(machine, text)] if text else [] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "spans"])

    return run


def _spans(texts: DataFrame, names: DataFrame, most_names: int) -> DataFrame:
    """row, spans: all occurrences in each text."""
    if names.count() > most_names:
        return _joined_spans(texts, names)
    mine = [r.name for r in names.collect()]  # most_names at most
    return texts.select("row", "text").mapInArrow(_finder(mine), "row long, spans array<struct<start:int,end:int>>")


def _joined_spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """row, spans: all occurrences in each text, by joining pieces of texts with names."""
    ends = lambda c: (F.substring(c, 1, 1).alias("first"), F.right(F.col(c), F.lit(1)).alias("last"))
    shapes = bounded(cut(names.select(F.length("name").alias("n"), *ends("name")).distinct()))
    # Dealt out, as each text becomes many pieces.
    at = texts.where("text <> ''").select("row", "text").repartition("row").select("row", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    pieces = at.withColumn("first", F.substring("text", F.col("at"), F.lit(1))).join(shapes, "first")
    pieces = pieces.where((F.col("at") + F.col("n") - 1 <= F.length("text")) & (F.substring("text", F.col("at") + F.col("n") - 1, F.lit(1)) == F.col("last")))
    pieces = pieces.select("row", "at", "n", F.substring("text", F.col("at"), F.col("n")).alias("name"))
    span = F.struct((F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col("n")).alias("end"))
    found = pieces.join(names, "name").groupBy("row").agg(F.collect_list(span).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return texts.select("row").join(found, "row", "left").select("row", F.coalesce("spans", none).alias("spans"))


def _prepared(texts: DataFrame, names: DataFrame, id_cols: list[str], text_col: str, name_col: str) -> tuple[DataFrame, DataFrame]:
    rows = texts.select(F.struct(*[F.col(c) for c in id_cols]).alias("ids"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return cut(rows), cut(names.select(F.col(name_col).cast("string").alias("name")).where("name <> ''").distinct())


def longest(texts: DataFrame, names: DataFrame, id_cols: list[str], text_col: str = "text", name_col: str = "name", out_col: str = "mention", most_names: int = MOST_NAMES) -> DataFrame:
    """``id_cols`` and the longest name that each text contains (of equally long ones the smallest), null without one."""
    rows, dictionary = _prepared(texts, names, id_cols, text_col, name_col)
    found = _spans(rows, dictionary, most_names).join(rows, "row")
    names_of = F.transform("spans", lambda s: F.struct((s["start"] - s["end"]).alias("shorter"), F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("name")))
    return found.select("ids.*", F.array_min(names_of)["name"].alias(out_col))


def mentions(texts: DataFrame, names: DataFrame, id_cols: list[str], text_col: str = "text", name_col: str = "name", most_names: int = MOST_NAMES) -> DataFrame:
    """``id_cols``, start, end, name: from the left, the longest name at each place, without overlap."""
    rows, dictionary = _prepared(texts, names, id_cols, text_col, name_col)
    found = _spans(rows, dictionary, most_names).join(rows, "row")
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    none = F.array().cast("array<struct<start:int,end:int>>")
    kept = F.aggregate(ordered, none, lambda out, s: F.when(F.coalesce(F.get(out, F.size(out) - 1)["end"], F.lit(0)) <= s["start"], F.array_append(out, s)).otherwise(out))
    out = found.select("ids.*", "text", F.explode(kept).alias("s"))
    return out.select(*id_cols, "s.start", "s.end", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("name"))


def slots(questions: DataFrame, entities: DataFrame, indicators: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols``, entity, indicator, years of every question: its longest known entity and indicator, and all its years."""
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit("(?<!\\d)((?:19|20)\\d{2})(?!\\d)"), F.lit(1)), lambda y: y.cast("int"))))
    rows = cut(questions.select(*id_cols, text_col, years.alias("years")).withColumn("__row", F.monotonically_increasing_id()))
    one = longest(rows, entities, ["__row"], text_col, out_col="entity")
    two = longest(rows, indicators, ["__row"], text_col, out_col="indicator")
    return rows.join(one, "__row").join(two, "__row").select(*id_cols, "entity", "indicator", "years")


def facts(nodes: DataFrame, edges: DataFrame, found: DataFrame, id_cols: list[str], most: int = 20) -> DataFrame:
    """The facts that fit the slots of every question: entity named exactly, phrase with the indicator, one of the years."""
    start, end = nodes.select(F.col("id").alias("s_id"), F.col("name").alias("s_name")), nodes.select(F.col("id").alias("o_id"), F.coalesce("value", "name").alias("o_value"))
    rows = found.where("entity is not null").join(start, F.col("entity") == F.col("s_name")).join(edges.select("src", "rel", "dst", F.col("year")), F.col("src") == F.col("s_id"))
    rows = rows.where(F.col("indicator").isNull() | F.contains("rel", F.col("indicator"))).where((F.size("years") == 0) | F.array_contains("years", F.col("year")))
    rows = rows.join(end, F.col("dst") == F.col("o_id")).select(*id_cols, "entity", F.col("rel").alias("phrase"), F.col("o_value").alias("value"), "year")
    first = Window.partitionBy(*id_cols).orderBy(F.col("year").desc_nulls_last(), "phrase", "value")
    return rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most).drop("__n")
