"""Property-graph tables from normalised triples: nodes, edges, keyed upserts, checks and counts.

nodes: id, label, name, value, numeric_value, unit, year, indicator, variable, source_file
edges: src, dst, rel, relation_id, year, confidence, context, source_doc
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions import rules
from kilngraph.functions.text import strip

#: Hex digits of a node id in the published form; the full digest is for graphs where 32 bits would collide.
SHORT_ID = 8
CONTEXT_CHARS = 500
NODE_COLUMNS = ["id", "label", "name", "value", "numeric_value", "unit", "year", "indicator", "variable", "source_file"]
EDGE_COLUMNS = ["src", "dst", "rel", "relation_id", "year", "confidence", "context", "source_doc"]


def node_id(label: Column, name: Column, digits: int = SHORT_ID) -> Column:
    digest = F.md5(F.concat(label, F.lit(":"), name).cast("binary"))
    return F.concat(label, F.lit("_"), F.substring(digest, 1, digits))


def first_number(text: Column) -> Column:
    digits = F.regexp_extract(text, "(\\d+\\.?\\d*)", 1)
    return F.when(digits != "", digits.cast("double"))


def unit_text(text: Column) -> Column:
    return F.nullif(strip(F.regexp_replace(text, "[\\d.]+", "")), F.lit(""))


def object_label(obj: Column, kind: Column, relation_id: Column, year: Column) -> Column:
    hint: Column | None = None
    for name, label in fixed.LABEL_HINTS.items():
        hint = F.when(relation_id == name, F.lit(label)) if hint is None else hint.when(relation_id == name, F.lit(label))
    entity = F.coalesce(rules.node_label(obj), hint, F.lit("Constraint"))
    return F.when(kind == "numerical_value", F.when(year.isNotNull(), "AnnualHydrologyData").otherwise("Constraint")).when(kind == "entity_reference", entity).otherwise("Constraint")


def _ends(triples: DataFrame, digits: int) -> DataFrame:
    """Triples with subject and object labels and ids; triples with a blank end are left out."""
    rows = triples.where((strip(F.col("subject")) != "") & (strip(F.col("object")) != "") & (strip(F.col("relation")) != ""))
    by_name = rules.node_label(F.col("subject"))
    subject_label = F.when(F.col("subject_type") != "Unknown", F.col("subject_type")).otherwise(F.coalesce(by_name, F.lit("Unknown")))
    rows = rows.withColumns({"s_label": subject_label, "o_label": object_label(F.col("object"), F.col("object_type"), F.col("relation_id"), F.col("year"))})
    return rows.withColumns({"src": node_id(F.col("s_label"), F.col("subject"), digits), "dst": node_id(F.col("o_label"), F.col("object"), digits)})


def build_nodes(triples: DataFrame, digits: int = SHORT_ID) -> DataFrame:
    """One node per (label, name); the properties are those of its first mention in (seq, part) order."""
    rows = _ends(triples, digits)
    none = F.lit(None).cast("string")
    subjects = rows.select(F.struct("seq", "part", F.lit(0).alias("end")).alias("at"), F.col("src").alias("id"), F.col("s_label").alias("label"), F.col("subject").alias("name"), none.alias("value"), F.lit(None).cast("double").alias("numeric_value"), none.alias("unit"), F.lit(None).cast("int").alias("year"), none.alias("indicator"), none.alias("variable"), "source_file")
    number, dated = F.col("object_type") == "numerical_value", F.col("year").isNotNull()
    named = F.col("o_label").isin("Constraint", "AnnualHydrologyData")
    objects = rows.select(
        F.struct("seq", "part", F.lit(1).alias("end")).alias("at"),
        F.col("dst").alias("id"),
        F.col("o_label").alias("label"),
        F.col("object").alias("name"),
        F.when(named, F.col("object")).alias("value"),
        F.when(number & ~dated, first_number(F.col("object"))).alias("numeric_value"),
        F.when(number, unit_text(F.col("object"))).alias("unit"),
        F.when(number & dated, F.col("year")).alias("year"),
        F.when(number & dated, F.col("relation")).alias("indicator"),
        F.when(number & ~dated, F.col("relation")).alias("variable"),
        "source_file",
    )
    both = subjects.unionByName(objects)
    # min_by combines map-side, so a name that most triples mention is one row per task.
    props = F.struct(*NODE_COLUMNS)
    return both.groupBy("id").agg(F.min_by(props, F.col("at")).alias("n")).select("n.*")


def build_edges(triples: DataFrame, digits: int = SHORT_ID, with_year: bool = True) -> DataFrame:
    """One edge per (src, rel, dst) and year; the last mention gives the properties.

    ``with_year=False`` is the published key, under which equal statements of two years collapse.
    """
    rows = _ends(triples, digits).select(F.struct("seq", "part").alias("at"), "src", "dst", F.col("relation").alias("rel"), "relation_id", "year", "confidence", F.substring("context", 1, CONTEXT_CHARS).alias("context"), F.nullif("source_file", F.lit("")).alias("source_doc"))
    key = ["src", "rel", "dst", *["year"] * with_year]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*EDGE_COLUMNS), F.col("at")).alias("e")).select("e.*")


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keyed merge: a new row's non-null values overwrite, everything else stays."""
    a, b = old.alias("a"), new.alias("b")
    merged = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(merged)


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, key: tuple[str, ...] = ("src", "rel", "dst", "year")) -> DataFrame:
    """Keyed merge of edges whose two ends exist among ``nodes``."""
    ids = nodes.select(F.col("id").alias("node"))
    valid = new.join(ids, F.col("src") == F.col("node"), "left_semi").join(ids, F.col("dst") == F.col("node"), "left_semi")
    rows = old.withColumn("age", F.lit(0)).unionByName(valid.withColumn("age", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.col("age").desc())
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "age")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that break the uniqueness constraint; empty in a sound graph."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def counts(nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """label, n for every label (or the given ones, zero if absent), with total_nodes and total_edges rows."""
    found = nodes.groupBy("label").agg(F.count("*").alias("n"))
    if labels is not None:
        wanted = nodes.sparkSession.createDataFrame([(x,) for x in labels], "wanted string")
        found = F.broadcast(wanted).join(found, F.col("wanted") == F.col("label"), "left").select(F.col("wanted").alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = found.agg(F.lit("total_nodes").alias("label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return found.unionByName(total).unionByName(edges.agg(F.lit("total_edges").alias("label"), F.count("*").alias("n")))
