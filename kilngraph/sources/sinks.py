"""Sinks: intermediate files, per-file and summary triples; ``GraphStore`` (full, append, dry run, deletion) is in ``graph_store``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.sources.graph_store import GraphStore

__all__ = ["GraphStore", "write_intermediate", "write_json", "write_parsed", "write_tables", "write_text_per_document"]


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, one folder per value of ``by`` if given."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_intermediate(files: DataFrame, path: str) -> None:
    """Intermediate rows as JSON, one object per document, in files that the reader's pattern finds.

    Spark names its own files; a folder per run and the suffix in the reader's pattern keep them apart from other JSON.
    """
    files.write.mode("overwrite").json(path)


def write_tables(pages: DataFrame, path: str, doc_col: str = "path") -> None:
    """The tables of pages as JSON, one folder per document: id, page, headers, rows, counts and Markdown."""
    name = F.element_at(F.split(doc_col, "/"), -1).alias("document")
    pages.select(name, F.explode("tables").alias("t")).select("document", "t.*").write.mode("overwrite").partitionBy("document").json(path)


def write_parsed(documents: DataFrame, pages: DataFrame, path: str, doc_col: str = "path") -> None:
    """Everything of parsed documents: full texts, tables, and a line of metadata each."""
    write_text_per_document(documents.withColumn("document", F.element_at(F.split(doc_col, "/"), -1)), f"{path}/texts", "document", "full_text")
    write_tables(pages, f"{path}/tables", doc_col)
    scan = pages.groupBy(F.col(doc_col).alias("__doc")).agg(F.bool_or(F.col("engine") == "layout").alias("is_scanned"), F.count_if("is_noise").alias("noise_pages"))
    rows = documents.join(scan, F.col(doc_col) == F.col("__doc"), "left").drop("__doc")
    write_json(rows.select(doc_col, "page_count", "is_scanned", "noise_pages", F.size("tables").alias("table_count"), F.length("full_text").alias("char_count")), f"{path}/meta")


def write_text_per_document(rows: DataFrame, path: str, doc_col: str, text_col: str) -> None:
    """Plain text, one folder per document."""
    rows.select(F.col(doc_col), F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(doc_col).text(path)
