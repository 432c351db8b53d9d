"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation again after every turn, so that a table holds it as prefixes of itself.  Each turn gets
a digest of its role and text and its place; a running XOR over these gives a hash of every turn prefix (128 bits, from two
independent halves).  A conversation whose full hash is a proper prefix hash of another is a snapshot of a longer one.
Distinct full hashes are anti-joined against distinct prefix hashes, so a conversation or a first turn that is repeated
any number of times is one row on either side.  What is left is maximal; of identical ones the smallest conv_id stays.
Only those conversations are rendered.

All steps are DataFrame functions.  Memory: running hashes are window sums over a conversation (sorted, with spill); only
rendering gathers the turns of one conversation in a row, as its output is one text.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null role or text counts as empty; rows that repeat
are separate turns; rows with a null conv_id form one conversation; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm.storage import materialise

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"


def _halves(*parts: Column) -> list[Column]:
    """Two signed 60-bit halves of an MD5 over length-prefixed parts."""
    text = F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])
    return [F.conv(F.substring(F.md5(text.cast("binary")), at, 15), 16, 10).cast("long") for at in (1, 17)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n_turns and the prefix hash h1, h2 up to each turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    rows = rows.withColumns(dict(zip(("t1", "t2"), _halves(F.col("pos").cast("string"), role, text), strict=True)))
    rows = rows.withColumns({"h1": F.bit_xor("t1").over(running), "h2": F.bit_xor("t2").over(running)})
    return rows.select("conv_id", "pos", F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"), "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of every conversation that no longer one extends and no equal one precedes."""
    hashes = materialise(prefix_hashes(turns), "chat-hashes")
    full = hashes.where("pos = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # min() skips nulls: only a class made of the null conversation alone keeps a null id.
    prefixes = hashes.where("pos < n_turns").select("h1", "h2", F.col("pos").cast("long").alias("n_turns")).distinct()
    return full.join(prefixes, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id and the chat text of every conversation of ``turns``."""
    turn = F.struct("turn", "role", "text")
    shown = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.concat(F.lit(TURN_OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(TURN_CLOSE)))
    return turns.groupBy("conv_id").agg(F.array_join(shown, "").alias("chat"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies and its rendered text."""
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    mine = turns.select("conv_id", "turn", "role", "text")
    same = F.col("conv_id").eqNullSafe(F.col("kept_id"))
    text = render(mine.join(kept.select("kept_id"), same, "left_semi"))
    return text.join(kept, same).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "chat")
