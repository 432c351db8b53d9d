"""Removal of the few: rows named in a short list go, without moving the rows that stay.

Defined cases: a null id is matched as a value; an empty list keeps all rows; further columns, and such with the names
used here, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.llm.storage import fresh

#: Listed rows up to which the list is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def without(docs: DataFrame, judged: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """``docs`` without the rows whose id and ``mark`` are in ``judged`` (id, mark, stays), a written table.

    Of rows that repeat an id and mark listed with ``stays``, one remains.  The listed rows are the few, so the texts of
    all others are not moved as long as the list is short enough to broadcast.
    """
    here, ident, name = (fresh(docs.columns, x) for x in ("__mark", "__id", "__of"))
    listed = judged.select(F.col("id").alias(ident), F.col("mark").alias(name), "stays")
    few = judged.count() <= BROADCAST_ROWS
    tagged = docs.withColumn(here, mark)
    meets = (F.col(here) == F.col(name)) & F.col(id_col).eqNullSafe(F.col(ident))
    side = listed.drop("stays")
    rest = tagged.join(F.broadcast(side) if few else side, meets, "left_anti")
    again = listed.where("stays").drop("stays")
    if not again.isEmpty():
        rest = rest.unionByName(tagged.join(again, meets, "left_semi").dropDuplicates([here, id_col]))
    return rest.select(docs.columns)
