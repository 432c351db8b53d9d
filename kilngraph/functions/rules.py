"""Ordered rule tables compiled to one CASE chain, so that matching stays inside the scan's code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed


def contains_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def holds(text: Column, kind: str, words: Sequence[str]) -> Column:
    """Whether one rule condition holds for ``text``."""
    match kind:
        case "contains":
            return contains_any(text, words)
        case "equals":
            return text.isin(list(words))
        case "suffix":
            return text.endswith(words[0])
        case "suffix2":  # a name of at least two characters
            return text.endswith(words[0]) & (F.length(text) > 1)
        case "longer3":
            return contains_any(text, words) & (F.length(text) > 3)
        case "sum":
            return F.contains(text, F.lit("+")) & contains_any(text, words)
        case "regex":
            return text.rlike(words[0])
    raise ValueError(f"unknown rule kind {kind}")


def first_match(text: Column, rules: Iterable[tuple[str, Sequence[str], str]], default: str | None = None) -> Column:
    """The result of the first rule (kind, words, result) that holds; a null text has the default."""
    chain: Column | None = None
    for kind, words, result in rules:
        condition = holds(text, kind, words)
        chain = F.when(condition, F.lit(result)) if chain is None else chain.when(condition, F.lit(result))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def first_word(text: Column, table: Iterable[tuple[str, str]]) -> Column:
    """The value of the first word of ``table`` that ``text`` contains, else null."""
    chain: Column | None = None
    for word, value in table:
        condition = F.contains(text, F.lit(word))
        chain = F.when(condition, F.lit(value)) if chain is None else chain.when(condition, F.lit(value))
    return chain


def subject_type(name: Column) -> Column:
    return first_match(F.trim(name), fixed.SUBJECT_TYPES, "Unknown")


def node_label(name: Column) -> Column:
    """Label of a graph node by its name, or null."""
    return first_match(F.trim(name), fixed.NODE_LABELS)


def exact_rules() -> list[tuple[str, str, bool]]:
    return fixed.RELATION_EXACT


def keyword_rules() -> list[tuple[tuple[str, ...], str | None, bool]]:
    return fixed.RELATION_KEYWORDS


def exact_rule_table(spark: SparkSession) -> DataFrame:
    """relation, relation_id, is_annual: a dimension table, small by construction."""
    return spark.createDataFrame(exact_rules(), "rule_relation string, rule_id string, rule_annual boolean")
