"""Documents to triples as one job: pages and tables, chunks, prompts, model calls, parsing, provenance, normalisation.

Every step is a projection or an explode, but for the numbering of chunks (by document), the order of the triples (one
range sort) and the deduplication.  Models and parsers are injected; answers are read from an answer store, so each
distinct prompt is asked once, and the sort reads written answers, not the model.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import tables as M
from kilngraph.functions import text as T
from kilngraph.lineage import cut, shared_root
from kilngraph.operators import chunking, extraction, normalising
from kilngraph.sources.answers import AnswerStore

TEXT_TEMPLATE = "Extract every stated fact of the text as a JSON array of objects with subject, relation and object.\n\nText:\n{text}"
TABLE_TEMPLATE = "Extract every value of the table, with its unit, as a JSON array of objects with subject, relation and object.\n\nTable:\n{table_markdown}\n\nContext: {context}"
#: Data rows of a table in one prompt.
TABLE_ROWS = 3


def intermediate(pages: DataFrame, doc_col: str = "path") -> DataFrame:
    """source_file, chunks, tables per document, the form of intermediate files; noise chunks go, tables get a context.

    ``pages`` are read twice: a frame that parses files is to be written first (``readers.parsed``).
    """
    name = F.element_at(F.split(doc_col, "/"), -1)
    chunks = chunking.usable(chunking.split_pages(pages.select(doc_col, "page_num", "text"), doc_col, "page_num"))
    chunk = F.struct("chunk_index", F.struct("chunk_id", T.strip(F.col("content")).alias("content"), "page_num", name.alias("source_file")).alias("c"))
    listed = chunks.groupBy(doc_col).agg(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["c"]).alias("chunks"))
    with_context = lambda t: F.struct(*[t[c].alias(c) for c in ("table_id", "page_num", "headers", "rows", "markdown", "row_count", "col_count")], name.alias("source_file"), T.table_context(name, t["page_num"]).alias("context"))
    tables = pages.groupBy(doc_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "tables"))), lambda p: p["tables"])).alias("found"))
    rows = tables.join(listed.withColumnRenamed(doc_col, "__doc"), F.col(doc_col) == F.col("__doc"), "left")
    return rows.select(name.alias("source_file"), F.coalesce("chunks", F.array().cast(listed.schema["chunks"].dataType)).alias("chunks"), F.transform("found", with_context).alias("tables"))


def text_prompts(files: DataFrame, template: str = TEXT_TEMPLATE, most_chunks: int | None = None) -> DataFrame:
    """One prompt per chunk of intermediate rows; ``most_chunks`` keeps the first of each file."""
    rows = files.select("source_file", F.posexplode("chunks").alias("place", "c")).select("source_file", "place", F.coalesce("c.page_num", F.lit(1)).alias("page_num"), F.coalesce("c.chunk_id", F.lit("")).alias("chunk_id"), F.col("c.content").alias("content"))
    rows = rows if most_chunks is None else rows.where(F.col("place") < most_chunks)
    return rows.select("source_file", "place", F.lit(0).alias("segment"), "page_num", "chunk_id", F.lit(None).cast("string").alias("table_id"), extraction.chat_prompt(extraction.fill_template(template, "text", F.col("content"))).alias("prompt"))


def table_prompts(files: DataFrame, template: str = TABLE_TEMPLATE, most_rows: int = TABLE_ROWS) -> DataFrame:
    """One prompt per segment of every non-blank table; units of the header are moved to the values first."""
    rows = files.select("source_file", F.posexplode("tables").alias("place", "t")).where(T.strip(F.coalesce("t.markdown", F.lit(""))) != "")
    rows = rows.select("source_file", "place", F.coalesce("t.page_num", F.lit(1)).alias("page_num"), F.coalesce("t.table_id", F.lit("")).alias("table_id"), F.coalesce("t.context", F.lit("")).alias("context"), M.embed_units(F.col("t.markdown")).alias("markdown"))
    rows = rows.select("*", F.posexplode(M.split_rows(F.col("markdown"), most_rows)).alias("segment", "part"))
    prompt = extraction.chat_prompt(extraction.fill_template(template, "table_markdown", F.col("part"), context=F.col("context")))
    return rows.select("source_file", "place", "segment", "page_num", F.lit(None).cast("string").alias("chunk_id"), "table_id", prompt.alias("prompt"))


def extract(files: DataFrame, generator: extraction.Generator, *, text_template: str = TEXT_TEMPLATE, table_template: str = TABLE_TEMPLATE, most_chunks: int | None = None, store: AnswerStore | None = None) -> DataFrame:
    """Raw triples of intermediate rows with seq: by file, text before tables, in reading order.

    Without a ``store`` the answers live in a work folder of this run.
    """
    store = store or AnswerStore(files.sparkSession, f"{shared_root(files.sparkSession)}/answers-{uuid.uuid4().hex}")
    keys = ("source_file", "place", "segment", "page_num", "chunk_id", "table_id")
    parts = []
    for kind, prompts, tokens in (("text", text_prompts(files, text_template, most_chunks), extraction.TEXT_TOKENS), ("tabular", table_prompts(files, table_template), extraction.TABLE_TOKENS)):
        answers = store.ask(cut(prompts), generator, tokens)
        parts.append(extraction.extract(answers, provenance=keys, data_type=kind if kind == "tabular" else None).withColumn("is_table", F.lit(kind == "tabular")))
    rows = cut(parts[0].unionByName(parts[1]))
    # A range sort numbers rows in reading order: the partitions are in order, and so are the rows of each.
    rows = rows.orderBy("source_file", "is_table", "place", "segment", "pos", "subject", "relation", "object").withColumn("seq", F.monotonically_increasing_id())
    return rows.drop("is_table", "place", "segment", "pos")


def to_triples(files: DataFrame, generator: extraction.Generator, index: DataFrame | None = None, **options) -> DataFrame:
    """Normalised triples of all files, each file deduplicated and then all files together."""
    rows = normalising.normalise(extract(files, generator, **options), index)
    return normalising.deduplicate(rows)
