"""Read queries over the node and edge tables; every LIMIT has a total order.

Edges are narrow and joined to nodes by id; filters on names, labels and relation ids reach the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions import rules


def _as(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns or df.columns])


def neighbours(nodes: DataFrame, edges: DataFrame, node: str | None = None, label: str | None = None) -> DataFrame:
    """A node, or all nodes of a label, with outgoing relations as an ordered list; without edges one entry of nulls."""
    mine = nodes if node is None else nodes.where(F.col("id") == node)
    mine = mine if label is None else mine.where(F.col("label") == label)
    out = (edges if node is None else edges.where(F.col("src") == node)).join(_as(nodes, "t", "id", "label", "name", "value"), F.col("dst") == F.col("t_id")).select("src", "rel", "t_label", "t_name", "t_value")
    listed = F.array_sort(F.collect_list(F.struct("rel", "t_label", "t_name", "t_value")))
    rows = mine.select("id").join(out, F.col("id") == F.col("src"), "left").groupBy(F.col("id").alias("of")).agg(listed.alias("relations"))
    return mine.join(rows, F.col("id") == F.col("of")).drop("of")


def dispatch_rules_of(nodes: DataFrame, edges: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """entity, name, content, applicable_period, condition, source_doc, confidence of the rules behind entities."""
    mine = edges if entities is None else edges.where(F.col("src").isin(entities))
    target = _as(nodes.where("label = 'DispatchRule'"), "t", "id", "name", "value", "year", "variable")
    rows = mine.join(target, F.col("dst") == F.col("t_id"))
    return rows.select(F.col("src").alias("entity"), F.col("t_name").alias("name"), F.coalesce("t_value", "t_name").alias("content"), F.col("t_year").cast("string").alias("applicable_period"), F.col("t_variable").alias("condition"), "source_doc", "confidence")


def search_names(nodes: DataFrame, keyword: str, label: str | None = None, most: int = 20) -> DataFrame:
    """Nodes whose name (or alias, if there is such a column) contains the keyword."""
    found = F.contains(F.col("name"), F.lit(keyword))
    found = found | F.contains(F.coalesce("alias", F.lit("")), F.lit(keyword)) if "alias" in nodes.columns else found
    rows = nodes.where(found) if label is None else nodes.where((F.col("label") == label) & found)
    return rows.orderBy("name", "id").limit(most)


def scan_label(nodes: DataFrame, label: str, most: int = 50) -> DataFrame:
    return nodes.where(F.col("label") == label).orderBy("name", "id").limit(most)


def linked_to(nodes: DataFrame, edges: DataFrame, node: str, label: str) -> DataFrame:
    """Targets of one label behind the node's edges: rules, constraints and the like."""
    target = _as(nodes.where(F.col("label") == label), "t")
    return edges.where(F.col("src") == node).join(target, F.col("dst") == F.col("t_id")).select("rel", "relation_id", "confidence", "source_doc", *target.columns)


def list_with_neighbours(nodes: DataFrame, edges: DataFrame, label: str, others: tuple[str, ...], most: int = 50, fan_out: bool = False) -> DataFrame:
    """Nodes of one label by name; with ``fan_out`` once per neighbour of the other labels, as published."""
    rows = nodes.where(F.col("label") == label).select("id", "name")
    if fan_out:
        near = edges.join(_as(nodes.where(F.col("label").isin(*others)), "o", "id", "name"), F.col("dst") == F.col("o_id")).select("src", F.col("o_name").alias("neighbour"))
        rows = rows.join(near, F.col("id") == F.col("src"), "left").select("id", "name", "neighbour")
        return rows.orderBy("name", "id", "neighbour").limit(most)
    return rows.orderBy("name", "id").limit(most)


def series(nodes: DataFrame, edges: DataFrame, entity: str | None = None, label: str | None = None, year: int | None = None, indicator: str | None = None, most: int = 100) -> DataFrame:
    """Yearly values behind an entity, newest first; every filter is optional."""
    start = nodes if entity is None else nodes.where(F.col("id") == entity)
    start = start if label is None else start.where(F.col("label") == label)
    facts = edges.where(F.col("year").isNotNull())
    facts = facts if year is None else facts.where(F.col("year") == year)
    facts = facts if not indicator else facts.where(F.contains(F.col("rel"), F.lit(indicator)))
    data = _as(nodes.where(F.col("label") == "AnnualHydrologyData"), "d", "id", "value", "unit")
    rows = facts.join(_as(start, "s", "id", "name"), F.col("src") == F.col("s_id")).join(data, F.col("dst") == F.col("d_id"))
    return rows.select("s_id", "s_name", "year", F.col("rel").alias("indicator"), F.col("d_value").alias("value"), F.col("d_unit").alias("unit")).orderBy(F.col("year").desc(), "s_id", "indicator", "value").limit(most)


def trace_document(nodes: DataFrame, edges: DataFrame, document: str, most: int = 100) -> DataFrame:
    """Triples that a document states."""
    rows = edges.where(F.col("source_doc") == document)
    rows = rows.join(_as(nodes, "s", "id", "name"), F.col("src") == F.col("s_id")).join(_as(nodes, "o", "id", "name"), F.col("dst") == F.col("o_id"))
    return rows.select(F.col("s_name").alias("subject"), F.col("rel").alias("predicate"), F.col("o_name").alias("object"), "confidence", "context").orderBy("subject", "predicate", "object").limit(most)


def search_triples(nodes: DataFrame, edges: DataFrame, keyword: str, most: int = 50) -> DataFrame:
    """Triples whose subject or object name contains the keyword, by confidence; missing confidence first.

    Names are filtered first; only edges with such an end meet the names of both their ends.
    """
    hit = nodes.where(F.contains("name", F.lit(keyword))).select(F.col("id").alias("hit"))
    return triples_at(nodes, edges, hit, most)


def triples_at(nodes: DataFrame, edges: DataFrame, hit: DataFrame, most: int = 50) -> DataFrame:
    """Triples with an end in ``hit`` (a column of ids), by confidence; missing confidence first."""
    hit = hit.toDF("hit")
    by_subject, by_object = F.col("src") == F.col("hit"), F.col("dst") == F.col("hit")
    rows = edges.join(hit, by_subject, "left_semi").unionByName(edges.join(hit, by_object, "left_semi").join(hit, by_subject, "left_anti"))
    # The best rows are picked before names are joined.
    rows = rows.select("src", F.col("rel").alias("predicate"), "dst", "confidence").orderBy(F.col("confidence").desc_nulls_first(), "src", "predicate", "dst").limit(most)
    rows = rows.join(_as(nodes, "s", "id", "name"), F.col("src") == F.col("s_id")).join(_as(nodes, "o", "id", "name"), F.col("dst") == F.col("o_id"))
    return rows.select(F.col("s_name").alias("subject"), "predicate", F.col("o_name").alias("object"), "confidence", "src", "dst").orderBy(F.col("confidence").desc_nulls_first(), "src", "predicate", "dst")


CONSTRAINT_RELATIONS = [x for ids in fixed.CONSTRAINT_IDS.values() for x in ids]


def constraints_of(nodes: DataFrame, edges: DataFrame, entities: list[str] | None, constraint_words: list[str], annual_words: list[str]) -> DataFrame:
    """Constraint and yearly edges of the entities (None: all): by relation id, or by words where the id is missing."""
    mine = edges if entities is None else edges.where(F.col("src").isin(entities))
    known = F.col("relation_id").isin(CONSTRAINT_RELATIONS)
    parts = []
    for label, words in (("Constraint", constraint_words), ("AnnualHydrologyData", annual_words)):
        target = _as(nodes.where(F.col("label") == label), "t", "id", "label", "name", "value", "unit", "variable", "indicator")
        by_word = F.col("relation_id").isNull() & rules.contains_any(F.col("rel"), words)
        parts.append(mine.where(known | by_word).join(target, F.col("dst") == F.col("t_id")))
    return reduce(DataFrame.unionByName, parts)


def parameter_key(relation_id: Column, relation: Column, name: Column) -> Column:
    by_id: Column | None = None
    for rid, key in fixed.PARAMETER_IDS.items():
        by_id = F.when(relation_id == rid, F.lit(key)) if by_id is None else by_id.when(relation_id == rid, F.lit(key))
    return F.coalesce(by_id, rules.first_word(relation, fixed.PARAMETER_WORDS), F.concat(F.lit("constraint_"), F.coalesce(name, F.lit("unknown"))))


def parameters_of(nodes: DataFrame, edges: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """src, key, value, unit, source_relation: the last statement of each key counts."""
    rows = edges if entities is None else edges.where(F.col("src").isin(entities))
    by_word = F.col("relation_id").isNull() & rules.contains_any(F.col("rel"), [w for w, _ in fixed.PARAMETER_WORDS])
    rows = rows.where(F.col("relation_id").isin(list(fixed.PARAMETER_IDS)) | by_word)
    rows = rows.join(_as(nodes.where("label = 'Constraint'"), "t", "id", "name", "value", "unit"), F.col("dst") == F.col("t_id"))
    rows = rows.withColumn("key", parameter_key(F.col("relation_id"), F.col("rel"), F.col("t_name")))
    last = F.max_by(F.struct(F.col("t_value").alias("value"), F.col("t_unit").alias("unit"), F.col("rel").alias("source_relation")), F.struct("rel", "dst"))
    return rows.groupBy("src", "key").agg(last.alias("p")).select("src", "key", "p.*")


def indicator_filter(words: list[str] | None) -> Column:
    """Edges of the indicator words: by their relation ids, or by the word itself where no id is known for it."""
    if not words:
        return F.col("relation_id").isin(sorted({i for ids in fixed.INDICATOR_IDS.values() for i in ids}))
    ids = sorted({i for w in words for key, found in fixed.INDICATOR_IDS.items() if key in w for i in found})
    rest = [w for w in words if not any(key in w for key in fixed.INDICATOR_IDS)]
    return F.col("relation_id").isin(ids) | (F.col("relation_id").isNull() & rules.contains_any(F.col("rel"), rest))


def series_or_neighbours(nodes: DataFrame, edges: DataFrame, words: list[str] | None = None, year: int | None = None, label: str = "Reservoir", via: str = "River", station: str = "HydrologicalStation", located: tuple[str, ...] = ("LOCATED_ON",), most: int = 200) -> DataFrame:
    """Yearly facts of every entity of ``label``; entities without any get those of stations at the same ``via`` node.

    One plan for all entities: the fallback side is anti-joined with the entities that have facts of their own.
    """
    facts = edges.where(F.col("year").isNotNull() & indicator_filter(words))
    facts = facts if year is None else facts.where(F.col("year") == year)
    facts = facts.join(_as(nodes.where("label = 'AnnualHydrologyData'"), "d", "id", "value", "unit"), F.col("dst") == F.col("d_id")).select(F.col("src").alias("fact_src"), "year", F.col("rel").alias("indicator"), F.col("d_value").alias("value"), F.col("d_unit").alias("unit"))
    ids = lambda x, name: nodes.where(F.col("label") == x).select(F.col("id").alias(name))
    direct = facts.join(ids(label, "entity"), F.col("fact_src") == F.col("entity")).withColumn("station", F.lit(None).cast("string"))
    place = edges.where(F.col("relation_id").isin(*located)).join(ids(via, "via_id"), F.col("dst") == F.col("via_id")).select("src", "via_id")
    mine = place.join(ids(label, "entity"), F.col("src") == F.col("entity")).select("entity", F.col("via_id").alias("at"))
    theirs = place.join(ids(station, "station"), F.col("src") == F.col("station")).select("station", "via_id")
    lone = mine.join(direct.select(F.col("entity").alias("has")).distinct(), F.col("entity") == F.col("has"), "left_anti")
    cols = ["station", "year", "indicator", "value", "unit"]
    first = lambda of: F.row_number().over(Window.partitionBy(of).orderBy("year", "indicator", "value", "station", "unit"))
    # An entity's first facts are among the first ones of each of its places, so only those meet the entities there.
    near = theirs.join(facts, F.col("station") == F.col("fact_src")).select("via_id", *cols).distinct()
    near = near.withColumn("n", first("via_id")).where(F.col("n") <= most).drop("n")
    indirect = lone.distinct().join(near, F.col("at") == F.col("via_id"))
    rows = direct.select("entity", *cols).unionByName(indirect.select("entity", *cols)).distinct()
    return rows.withColumn("n", first("entity")).where(F.col("n") <= most).drop("n")


def upstream_pairs(nodes: DataFrame, edges: DataFrame, entities: DataFrame, mark: str = "距", symmetric: bool = False) -> DataFrame:
    """(upstream, downstream) of entities (id, ord): an edge to a constraint whose phrase holds the other's name and ``mark``.

    Names are found in phrases by an equi-join on the phrase's substrings of the lengths that names have, so no pair of
    entities is formed that no phrase supports.  Unless ``symmetric``, only pairs in the order of ``ord`` count.
    """
    named = nodes.join(entities.select(F.col("id").alias("of"), "ord"), F.col("id") == F.col("of")).where("name <> ''").select("id", "name", "ord")
    marked = edges.where(F.contains("rel", F.lit(mark))).join(nodes.where("label = 'Constraint'").select(F.col("id").alias("c_id")), F.col("dst") == F.col("c_id"), "left_semi")
    longest = marked.agg(F.max(F.length("rel"))).first()[0] or 0
    sizes = sorted(r.n for r in named.select(F.length("name").alias("n")).where(F.col("n") <= longest).distinct().collect())  # at most the longest phrase's length
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("rel") - n + 1, F.lit(1))), lambda i: F.substring(F.col("rel"), i, F.lit(n)))
    empty = F.array().cast("array<string>")
    held = marked.select("src", F.explode(F.array_distinct(F.concat(empty, *[at(n) for n in sizes]))).alias("held")).distinct()
    up, down = _as(named, "up", "id", "ord"), _as(named, "down", "id", "name", "ord")
    rows = held.join(up, F.col("src") == F.col("up_id")).join(down, F.col("held") == F.col("down_name")).where("up_id <> down_id")
    rows = rows if symmetric else rows.where("up_ord < down_ord")
    return rows.select(F.col("up_id").alias("upstream"), F.col("down_id").alias("downstream")).distinct()
