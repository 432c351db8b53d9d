"""Prompts, model hooks, response parsing and repair, validation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions.text import strip

TRIPLE = "struct<subject:string,relation:string,object:string,context:string,confidence:double,data_type:string,year:string>"
#: Token limits of the text and table calls, and the context size; passed on to the generator.
TEXT_TOKENS, TABLE_TOKENS, CONTEXT_TOKENS = 8192, 4096, 8192

Generator = Callable[[list[str], int], list[str]]


def chat_prompt(content: Column, system: str = fixed.CHAT_SYSTEM) -> Column:
    """System and user turns, then the opening of the model's turn."""
    turn = lambda role, text: F.concat(F.lit(f"{fixed.CHAT_OPEN}{role}\n"), text, F.lit(f"{fixed.CHAT_CLOSE}\n"))
    return F.concat(turn("system", F.lit(system)), turn("user", content), F.lit(f"{fixed.CHAT_OPEN}model\n"))


def fill_template(template: str, slot: str, value: Column, **more: Column) -> Column:
    """``template`` with {slot}, and the slots of ``more``, replaced; doubled braces stand for single ones."""
    values = {slot: value, **more}
    parts = re.split("\\{(" + "|".join(map(re.escape, values)) + ")\\}", template)
    plain = lambda t: F.lit(t.replace("{{", "{").replace("}}", "}"))
    return F.concat(*[values[part] if i % 2 else plain(part) for i, part in enumerate(parts)])


def generate(rows: DataFrame, generator: Generator, prompt_col: str = "prompt", out_col: str = "response", max_tokens: int = TEXT_TOKENS) -> DataFrame:
    """Call an injected model over Arrow batches; blank prompts get an empty response without a call."""
    names = rows.columns

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame[prompt_col].fillna("").str.strip() != ""
            answers = pd.Series("", index=frame.index, dtype=object)
            if asked.any():
                answers[asked] = generator(frame.loc[asked, prompt_col].tolist(), max_tokens)
            yield frame.assign(**{out_col: answers})[[*names, out_col]]

    schema = rows.select("*", F.lit("").alias(out_col)).schema
    return rows.mapInPandas(call, schema)


def _unfence(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(text, "^```[^\\n]*\\n", ""), "\\n```[^\\n]*$", "")
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


#: Strings whole, and every other character that a value may end with.
_ENDS = re.compile(r'"(?:[^"\\]|\\.)*"|[}\]0-9elNy]', re.DOTALL)


def repair_array(text: str | None) -> str | None:
    """The longest readable beginning of a cut-off JSON array, closed by counting brackets; None if there is none."""
    if not text:
        return None
    try:
        json.loads(text)
        return None
    except json.JSONDecodeError as error:
        head = text[: error.pos].rstrip()
    # What precedes the error has been read, so a cut within one of its strings leaves that string open; the others end values.
    for cut in [m.end() for m in _ENDS.finditer(head)][::-1]:
        attempt = head[:cut]
        fixed_text = attempt + "}" * (attempt.count("{") - attempt.count("}")) + "]" * (attempt.count("[") - attempt.count("]"))
        try:
            if isinstance(json.loads(fixed_text), list):
                return fixed_text
        except json.JSONDecodeError:
            pass
    return None


@F.pandas_udf(StringType())
def _repaired(text: pd.Series) -> pd.Series:
    return text.map(repair_array)


def parse_response(response: Column) -> Column:
    """Array of triples in a model's answer, valid ones only; null where nothing can be read.

    An array, or an object with ``triplets`` or ``data``; else from the first '[' on, repaired if it is cut off.
    """
    text = _unfence(F.coalesce(response, F.lit("")))
    as_array = F.when(strip(text).startswith("["), F.from_json(text, f"array<{TRIPLE}>"))
    wrapped = F.from_json(text, f"struct<triplets:array<{TRIPLE}>,data:array<{TRIPLE}>>")
    as_object = F.when(strip(text).startswith("{"), F.coalesce(wrapped["triplets"], wrapped["data"]))
    tail = F.substring(text, F.instr(text, "["), F.length(text))
    tail = F.when(F.instr(text, "[") > 0, tail)
    whole = F.from_json(tail, f"array<{TRIPLE}>")
    cut = F.from_json(_repaired(F.when(F.try_parse_json(tail).isNull(), tail)), f"array<{TRIPLE}>")
    return validate(F.coalesce(as_array, as_object, F.when(F.try_parse_json(tail).isNotNull(), whole), cut))


def validate(triples: Column) -> Column:
    """Drop triples with a blank part, fill the defaults."""
    full = lambda t: (strip(F.coalesce(t["subject"], F.lit(""))) != "") & (strip(F.coalesce(t["relation"], F.lit(""))) != "") & (strip(F.coalesce(t["object"], F.lit(""))) != "")

    def filled(t: Column) -> Column:
        return F.struct(
            t["subject"].alias("subject"),
            t["relation"].alias("relation"),
            t["object"].alias("object"),
            F.coalesce(t["context"], F.lit("")).alias("context"),
            F.coalesce(t["confidence"], F.lit(0.85)).alias("confidence"),
            F.coalesce(t["data_type"], F.lit("text")).alias("data_type"),
            t["year"].alias("year"),
        )

    return F.transform(F.filter(triples, full), filled)


def extract(rows: DataFrame, response_col: str = "response", provenance: tuple[str, ...] = ("source_file", "page_num", "chunk_id"), data_type: str | None = None) -> DataFrame:
    """One row per triple, with the provenance columns that ``rows`` has (page_num defaults to 1); ``data_type`` overrides the model's."""
    have = [c for c in provenance if c in rows.columns]
    out = rows.select(*have, F.posexplode(parse_response(F.col(response_col))).alias("pos", "t")).select(*have, "pos", "t.*")
    out = out if data_type is None else out.withColumn("data_type", F.lit(data_type))
    return out.withColumn("page_num", F.coalesce("page_num", F.lit(1))) if "page_num" in have else out


def limit_per_file(chunks: DataFrame, most: int, file_col: str = "source_file", order_col: str = "chunk_index") -> DataFrame:
    first = Window.partitionBy(file_col).orderBy(order_col)
    return chunks.withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= most).drop("__place")
