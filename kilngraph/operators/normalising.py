"""Triple normalisation: entities, relations, years, object classes, splitting, deduplication and statistics.

Input rows are raw triples with ``seq``, their input order.  Everything up to deduplication is a projection over broadcast
dimension tables; deduplication is the one shuffle, by (subject, year, object).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions import rules
from kilngraph.functions.text import strip
from kilngraph.lineage import cut
from kilngraph.operators.linking import link

_LIST_MARK = "[、，,]"
#: Slices in which the largest counts of a report are looked for.
SLICES = 256


def relation_year(relation: Column) -> Column:
    """A single year in the phrase; year ranges are removed first."""
    single = F.regexp_extract(F.regexp_replace(relation, "\\d{4}~\\d{4}年", ""), "(?<!~)(\\d{4})年", 1)
    return F.when(single != "", single.cast("int"))


def file_year(file: Column) -> Column:
    year = F.regexp_extract(F.coalesce(file, F.lit("")), "(\\d{4})", 1)
    return F.when(year != "", year.cast("int"))


def determine_year(relation: Column, file: Column, is_annual: Column) -> Column:
    """The triple's year, or null for a constant."""
    of_file = file_year(file)
    last = F.when(F.contains(relation, F.lit("上年")), of_file - 1)
    return F.coalesce(relation_year(relation), last, F.when(is_annual, of_file))


def year_text(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("constant"))


def match_relation(triples: DataFrame, relation_col: str = "relation") -> DataFrame:
    """Adds relation_id, rel_confidence, is_annual and rel_method.

    Exact phrases by a broadcast join on the rule table; keyword rules as one CASE chain in rule order.
    """
    spark = triples.sparkSession
    exact = F.broadcast(rules.exact_rule_table(spark))
    text = strip(F.coalesce(F.col(relation_col), F.lit("")))
    rows = triples.withColumn("rel_text", text).join(exact, F.col("rel_text") == F.col("rule_relation"), "left")
    table = [(word, name, annual) for words, name, annual in rules.keyword_rules() for word in words]
    chain = " ".join(f"WHEN contains(rel_text, '{word}') THEN {i}" for i, (word, _, _) in enumerate(table, 1))
    rows = rows.withColumn("kw", F.expr(f"CASE {chain} END"))
    pick = lambda values, kind: F.element_at(F.expr(f"array({', '.join(values)})").cast(f"array<{kind}>"), F.col("kw"))
    exact_hit, empty, by_word = F.col("rule_relation").isNotNull(), F.col("rel_text") == "", F.col("kw").isNotNull()
    rows = rows.withColumns(
        {
            "relation_id": F.when(exact_hit, F.col("rule_id")).when(by_word, pick([f"'{n}'" if n else "NULL" for _, n, _ in table], "string")),
            "rel_confidence": F.when(empty, 0.0).when(exact_hit, 0.99).when(by_word, 0.85).otherwise(0.4),
            "is_annual": F.when(empty, False).when(exact_hit, F.col("rule_annual")).when(by_word, pick([str(a) for _, _, a in table], "boolean")).otherwise(rules.contains_any(F.col("rel_text"), fixed.YEARLY_WORDS)),
            "rel_method": F.when(empty, "none").when(exact_hit, "exact").when(by_word, F.concat(F.lit("keyword:"), pick([f"'{w}'" for w, _, _ in table], "string"))).otherwise("heuristic"),
        }
    )
    return rows.drop("rel_text", "rule_relation", "rule_id", "rule_annual", "kw")


#: (relation id or None, confidence) for each of a list of phrases.
RelationResolver = Callable[[list[str]], list[tuple[str | None, float]]]


def resolve_relations(rows: DataFrame, resolver: RelationResolver) -> DataFrame:
    """Relations that no rule matched, named by an injected model; each distinct phrase is asked once."""
    asked = rows.where("rel_method = 'heuristic'").select(F.col("relation").alias("asked")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = resolver(frame["asked"].tolist()) if len(frame) else []
            yield frame.assign(llm_id=pd.Series([x[0] for x in found], index=frame.index, dtype=object), llm_confidence=pd.Series([float(x[1]) for x in found], index=frame.index, dtype=float))

    # Written once: a model is not to be asked again by a retried or repeated plan.
    answers = cut(asked.mapInPandas(run, "asked string, llm_id string, llm_confidence double"))
    rows = rows.join(answers, F.col("relation") == F.col("asked"), "left")
    hit = (F.col("rel_method") == "heuristic") & F.col("llm_confidence").isNotNull()
    yearly = F.contains("relation", F.lit("径流")) | F.contains("relation", F.lit("量"))
    columns = {"relation_id": F.when(hit, F.col("llm_id")).otherwise(F.col("relation_id")), "rel_confidence": F.when(hit, F.col("llm_confidence")).otherwise(F.col("rel_confidence")), "is_annual": F.when(hit, yearly).otherwise(F.col("is_annual")), "rel_method": F.when(hit, F.lit("llm")).otherwise(F.col("rel_method"))}
    return rows.withColumns(columns).drop("asked", "llm_id", "llm_confidence")


def match_rate(triples: DataFrame) -> DataFrame:
    """total, exact, keyword, unmatched and match_rate: the percentage of input rows whose relation a rule knows."""
    count = lambda c: F.count_if(c).alias
    method = F.col("rel_method")
    rows = match_relation(triples).agg(F.count("*").alias("total"), count(method == "exact")("exact"), count(method.startswith("keyword"))("keyword"), count(method.isin("heuristic", "none"))("unmatched"))
    return rows.withColumn("match_rate", F.round((F.col("exact") + F.col("keyword")) / F.greatest(F.col("total"), F.lit(1)) * 100, 1))


def classify_object(obj: Column, linked: Column | None = None) -> Column:
    """invalid, composite, numerical_value or entity_reference; ``linked`` says whether an alias with 0.9 or more is known."""
    obj = strip(obj)
    parts = F.filter(F.split(obj, _LIST_MARK), lambda p: ~p.rlike("\\d"))
    known = rules.contains_any(obj, fixed.ENTITY_WORDS)
    known = known if linked is None else linked | known
    return (
        F.when(F.coalesce(obj, F.lit("")) == "", "invalid")
        .when(obj.rlike(_LIST_MARK) & (F.size(parts) >= 2), "composite")
        .when(obj.rlike("\\d"), "numerical_value")
        .when(known, "entity_reference")
        .otherwise("numerical_value")
    )


def has_number(obj: Column) -> Column:
    return obj.rlike("\\d+\\.?\\d*")


def _linked_object(rows: DataFrame, index: DataFrame | None, raw: str, out: str) -> DataFrame:
    """``out``: the standard name of an object without a short number, else the object; ``linked_<out>``: whether an alias is known.

    A standard name maps to itself, so one lookup of the name answers both.
    """
    name = strip(F.coalesce(F.col(raw), F.lit("")))
    if index is None:
        return rows.withColumns({out: name, f"linked_{out}": F.lit(False)})
    numeric = name.rlike("\\d") & (F.length(name) < 50)
    rows = link(rows.withColumn("link_key", name), index, "link_key").withColumnRenamed("matched", f"linked_{out}")
    rows = rows.withColumn(out, F.when(F.col(f"linked_{out}") & ~numeric, F.col("standardized")).otherwise(name))
    return rows.drop("link_key", "original", "standardized", "method", "confidence")


NORMALISED = ("seq", "part", "subject", "subject_type", "subject_new", "relation", "relation_id", "object", "object_type", "year", "context", "confidence", "source_file", "rel_method", "is_annual")


def normalise(triples: DataFrame, index: DataFrame | None = None, resolver: RelationResolver | None = None) -> DataFrame:
    """Normalised triples before deduplication: one row per triple, or per part of a composite object.

    ``seq`` and ``part`` keep the order; invalid objects are dropped.  ``confidence`` is the raw product.  Rows that are
    normalised already (with a subject_type, in a frame with the columns of the result) pass through unchanged, so that
    their confidence is not multiplied again.  ``resolver`` may name relations that no rule knows.
    """
    if {"subject_type", "relation_id"} <= set(triples.columns):
        done = triples.where(F.col("subject_type").isNotNull()).select(*NORMALISED)
        raw = triples.where(F.col("subject_type").isNull()).select("seq", "subject", "relation", "object", "context", "confidence", "source_file")
        return normalise(raw, index, resolver).unionByName(done)
    base = triples.select("seq", "subject", "relation", F.col("object").alias("raw_object"), "context", F.coalesce(F.col("confidence"), F.lit(0.8)).alias("raw_confidence"), F.coalesce(F.col("source_file"), F.lit("")).alias("source_file"))
    name = strip(F.coalesce(F.col("subject"), F.lit("")))
    base = base.withColumn("subject", name)
    if index is not None:
        index = cut(index)  # looked up several times below
        base = link(base, index, "subject").withColumn("subject", F.coalesce("standardized", "subject")).withColumnRenamed("matched", "subject_known").drop("original", "standardized", "method", "confidence")
    else:
        base = base.withColumn("subject_known", F.lit(False))
    base = base.withColumn("subject_type", F.when(F.col("subject") == "", "Unknown").otherwise(rules.subject_type(F.col("subject"))))
    base = base.withColumn("subject_new", (F.col("subject") == "") | (~F.col("subject_known") & F.col("subject_type").isin(fixed.NEW_ENTITY_TYPES)))
    base = match_relation(base)
    base = base if resolver is None else resolve_relations(base, resolver)
    base = base.withColumn("year", determine_year(F.col("relation"), F.col("source_file"), F.col("is_annual")))
    base = _linked_object(base, index, "raw_object", "object")
    base = base.withColumn("object_type", classify_object(F.col("object"), F.col("linked_object"))).where(~F.col("object").isin(fixed.INVALID_OBJECTS))
    base = base.withColumn("confidence", F.col("raw_confidence") * F.col("rel_confidence"))
    parts = F.filter(F.transform(F.split("object", _LIST_MARK), strip), lambda p: p != "")
    parts = F.when((F.col("object_type") == "composite") & (F.size(parts) > 1), parts).otherwise(F.array("object"))
    rows = base.withColumn("whole", F.size(parts) == 1).select("*", F.posexplode(parts).alias("part", "part_object"))
    rows = _linked_object(rows.drop("object", "linked_object").withColumnRenamed("confidence", "product").withColumnRenamed("object_type", "whole_type"), index, "part_object", "object")
    rows = rows.withColumn("object_type", F.when(F.col("whole"), F.col("whole_type")).otherwise(classify_object(F.col("object"), F.col("linked_object"))))
    return rows.withColumn("confidence", F.col("product")).select(*NORMALISED)


def deduplicate(triples: DataFrame, with_relation: bool = False) -> DataFrame:
    """The best triple of each (subject, year, object): a year in the phrase first, then confidence, then input order.

    ``with_relation`` adds the relation id to the key, so that two indicators with one value stay apart.
    """
    key = ["subject", "year", "object", *["relation_id"] * with_relation]
    rest = [c for c in triples.columns if c not in key]
    # max_by combines map-side, so a key that most rows share is one row per task.
    best = F.max_by(F.struct(*rest), preference()).alias("best")
    return triples.groupBy(*key).agg(best).select(*[c if c in key else F.col("best")[c].alias(c) for c in triples.columns])


def preference() -> Column:
    """What the best of several equal statements is greatest by: a year in the phrase, confidence, and being the first."""
    dated = F.coalesce(F.col("relation").rlike("\\d{4}年"), F.lit(False)).cast("int")
    return F.struct(dated.alias("dated"), F.col("confidence"), (-F.col("seq")).alias("seq"), (-F.col("part")).alias("part"))


def _counters() -> dict[str, Column]:
    """Counters over normalised rows."""
    return {
        "relations_exact": F.col("rel_method") == "exact",
        "relations_keyword": F.col("rel_method").startswith("keyword"),
        "relations_unmatched": F.col("rel_method").isin("heuristic", "none"),
        "entities_new": F.col("subject_new"),
        "objects_numerical": F.col("object_type") == "numerical_value",
        "objects_entity": F.col("object_type") == "entity_reference",
        "split_added": F.col("part") > 0,
    }


def observed(normalised: DataFrame, name: str = "normalised") -> tuple[DataFrame, Observation]:
    """``normalised`` with its counters observed: whatever writes it fills them in its own pass, streams batch by batch.

    A stage that is run again after a lost executor may count its rows again; ``statistics`` never does.
    """
    watch = Observation(name)
    counted = [F.count_if(c).alias(n) for n, c in _counters().items()]
    return normalised.observe(watch, *counted, F.count(F.lit(1)).alias("normalised")), watch


def statistics(raw: DataFrame, normalised: DataFrame) -> DataFrame:
    """One row of counters over one run; ``normalised`` is read once.

    Counters are added up per key of the deduplication, which a task combines first, so the number of keys is the number
    of triples that stay, and no second pass is needed.
    """
    counters = _counters()
    keys = normalised.groupBy("subject", "year", "object").agg(*[F.count_if(c).alias(n) for n, c in counters.items()], F.count("*").alias("normalised"))
    total = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*counters, "normalised")]
    after = keys.agg(*total, F.count("*").alias("kept"))
    return raw.agg(F.count("*").alias("total")).join(after).withColumn("deduplicated", F.col("normalised") - F.col("kept"))


def report(triples: DataFrame, most: int = 20) -> DataFrame:
    """dimension, value, n: counts by subject type, relation id, year and unmatched relation.

    Each row gives four narrow (dimension, value) pairs, counted map-side in one aggregation; ``rank`` is given within the
    ``most`` largest counts of the open dimensions, which are picked by one more aggregation and not by sorting all phrases.
    """
    rows = triples.select("subject_type", "relation_id", year_text(F.col("year")).alias("year"), F.when(F.col("relation_id").isNull(), F.col("relation")).alias("unmatched"))
    keys = ["subject_type", "relation_id", "year", "unmatched"]
    picked = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys]))
    counts = rows.select(picked.alias("p")).where("p.value is not null").groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    open_ = F.col("dimension").isin("relation_id", "unmatched")
    # Phrases are free text: their largest counts are found per slice of a hash first, so no task sorts all of them.
    slice_ = Window.partitionBy("dimension", F.pmod(F.xxhash64("value"), F.lit(SLICES))).orderBy(F.col("n").desc(), "value")
    few = counts.withColumn("place", F.row_number().over(slice_)).where(~open_ | (F.col("place") <= most)).drop("place")
    order = Window.partitionBy("dimension").orderBy(F.col("n").desc(), "value")
    return few.withColumn("rank", F.row_number().over(order)).where(~(open_ & (F.col("rank") > most)))
