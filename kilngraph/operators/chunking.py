"""Text to chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions import text as T


def split_text(docs: DataFrame, text_col: str = "text", size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, separators: list[str] = fixed.SEPARATORS) -> DataFrame:
    """One row per chunk, with chunk_index, chunk_id and char_count; all other columns are kept."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, F.posexplode(T.chunks(F.col(text_col), size, overlap, separators)).alias("chunk_index", "content"))
    return rows.withColumns({"chunk_id": F.format_string("chunk_%04d", "chunk_index"), "char_count": F.length("content")})


def split_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", **options) -> DataFrame:
    """Chunks of every non-blank page, numbered through the whole document."""
    rows = split_text(pages.where(T.strip(F.col(text_col)) != ""), text_col, **options).withColumnRenamed("chunk_index", "page_chunk")
    order = Window.partitionBy(doc_col).orderBy(page_col, "page_chunk")
    rows = rows.withColumn("chunk_index", F.row_number().over(order) - 1)
    return rows.withColumn("chunk_id", F.format_string("chunk_%04d", "chunk_index")).drop("page_chunk")


def usable(chunks: DataFrame) -> DataFrame:
    """Chunks that are long enough and not noise."""
    return chunks.where(T.keep_chunk(F.col("content")))
