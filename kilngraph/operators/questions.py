"""Natural-language questions: slots, a typed filter plan over the graph, and the answer text.

A question never becomes query text: it yields a Slots value, from which whitelisted filters are built.  A model may be
injected to fill the slots; the default filler looks up known entity names, indicator words and years.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.operators.queries import _as

MOST_ROWS, SHOWN_ROWS, PLAIN_ROWS = 20, 8, 5


@dataclass(frozen=True)
class Slots:
    entity: str | None = None
    indicator: str | None = None
    years: tuple[int, ...] = field(default=())


SlotFiller = Callable[[str], Slots]


def keyword_filler(entities: list[str], indicators: list[str]) -> SlotFiller:
    """The longest known entity and indicator in the question, and every four-digit year."""

    def fill(question: str) -> Slots:
        longest = lambda words: max((w for w in words if w in question), key=len, default=None)
        return Slots(longest(entities), longest(indicators), tuple(sorted({int(y) for y in re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", question)})))

    return fill


def plan(nodes: DataFrame, edges: DataFrame, slots: Slots, most: int = MOST_ROWS) -> DataFrame:
    """entity, indicator, value, unit, year: facts that fit the slots, newest first."""
    start = nodes if slots.entity is None else nodes.where(F.contains("name", F.lit(slots.entity)))
    facts = edges if slots.indicator is None else edges.where(F.contains("rel", F.lit(slots.indicator)))
    facts = facts.where(F.col("year").isin(list(slots.years))) if slots.years else facts
    rows = facts.join(_as(start, "s", "id", "name"), F.col("src") == F.col("s_id")).join(_as(nodes, "o", "id", "name", "value", "unit"), F.col("dst") == F.col("o_id"))
    rows = rows.select(F.col("s_name").alias("entity"), F.col("rel").alias("indicator"), F.coalesce("o_value", "o_name").alias("value"), F.col("o_unit").alias("unit"), "year")
    return rows.orderBy(F.col("year").desc_nulls_last(), "entity", "indicator", "value").limit(most)


def described(slots: Slots, most: int = MOST_ROWS) -> str:
    """The filter plan of a question as text, for display only; it is never executed."""
    parts = [f"subject contains '{slots.entity}'"] * (slots.entity is not None) + [f"relation contains '{slots.indicator}'"] * (slots.indicator is not None)
    parts += [f"year in {list(slots.years)}"] * bool(slots.years)
    return f"facts where {' and '.join(parts) or 'true'}, newest first, at most {most}"


def answer(rows: DataFrame, question: str, most: int = SHOWN_ROWS, most_plain: int = PLAIN_ROWS) -> DataFrame:
    """One row with the answer: up to eight bullet lines and a note on how many rows there are.

    A line shows what the row has of entity (or name), year, indicator and value; rows of other columns, or without any
    of these, are shown as ``column: value`` instead, five at most.
    """
    known = lambda *names: next((F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in rows.columns), F.lit(None).cast("string"))
    entity, indicator, value, year = known("entity", "name"), known("indicator"), known("value"), known("year")
    keys = [F.col("year").desc_nulls_last()] * ("year" in rows.columns) + [F.col(c) for c in ("entity", "name", "indicator", "value") if c in rows.columns] or [F.col(c) for c in rows.columns]
    name = F.when(entity.isNull(), None).otherwise(F.concat(entity, F.when(year.isNotNull(), F.concat(F.lit("("), year, F.lit("年)"))).otherwise("")))
    line = F.nullif(F.concat_ws(" | ", name, indicator, value), F.lit(""))
    plain = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in rows.columns])
    numbered = rows.select(F.row_number().over(Window.orderBy(*keys)).alias("n"), line.alias("line"), plain.alias("plain"))  # at most MOST_ROWS rows
    listed = lambda column, top: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("n") <= top) & F.col(column).isNotNull(), F.struct("n", F.concat(F.lit("• "), F.col(column)).alias("x"))))), lambda x: x["x"]), "\n")
    shown = F.coalesce(F.nullif(listed("line", most), F.lit("")), listed("plain", most_plain))
    note = F.when(F.count("*") > most, F.concat(F.lit("\n... 共 "), F.count("*").cast("string"), F.lit(" 条结果"))).otherwise("")
    none = F.lit(f"未找到与「{question}」相关的数据，请尝试换个问法。")
    return numbered.agg(F.when(F.count("*") == 0, none).otherwise(F.concat(shown, note)).alias("answer"), F.count("*").alias("n_rows"))


def ask(nodes: DataFrame, edges: DataFrame, question: str, filler: SlotFiller) -> DataFrame:
    return answer(plan(nodes, edges, filler(question)), question)
