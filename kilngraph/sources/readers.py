"""Sources: documents, pages, images, intermediate files, triples, ontologies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilngraph import schemas
from kilngraph.functions import tables as M
from kilngraph.functions import text as T
from kilngraph.lineage import cut

#: File name patterns of the binary sources.
PDF_GLOB, IMAGE_GLOB = "*.[pP][dD][fF]", "*.{jpg,jpeg,png,bmp,tiff,tif,webp,JPG,JPEG,PNG,BMP,TIFF,TIF,WEBP}"
#: Native text longer than this makes recognition needless; pages that decide whether a document is scanned.
NATIVE_CHARS, SCAN_PAGES = 50, 3

PageParser = Callable[[bytes], list[dict]]


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path and content of every matching file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


PAGE = "page_num int, native_text string, ocr_text string, found_tables array<struct<markdown:string,html:string>>, boxes array<struct<label:string,bbox:array<double>>>, error string"
PAGE_COLUMNS = ["path", "page_num", "native_text", "ocr_text", "found_tables", "boxes", "error"]
PAGE_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("page_num", pa.int32()),
        ("native_text", pa.string()),
        ("ocr_text", pa.string()),
        ("found_tables", pa.list_(pa.struct([("markdown", pa.string()), ("html", pa.string())]))),
        ("boxes", pa.list_(pa.struct([("label", pa.string()), ("bbox", pa.list_(pa.float64()))]))),
        ("error", pa.string()),
    ]
)


def page_row(path: str, i: int, p: dict) -> tuple:
    """The row of a parser's page: any of page_num, native_text, ocr_text or rec_texts, tables and boxes."""
    lines = p.get("ocr_text") if "ocr_text" in p else "\n".join(str(t) for t in p["rec_texts"] if t) if "rec_texts" in p else None
    found = [{"markdown": t.get("markdown"), "html": t.get("html")} for t in p.get("tables") or []]
    boxes = [{"label": x.get("label"), "bbox": [float(v) for v in x.get("bbox") or []]} for x in p.get("boxes") or []]
    return (path, p.get("page_num", i + 1), p.get("native_text"), lines, found, boxes, None)


def error_row(path: str, error: Exception) -> tuple:
    return (path, 0, None, None, [], [], f"{type(error).__name__}: {error}"[:500])


def parse_pages(files: DataFrame, parser: PageParser) -> DataFrame:
    """Pages of binary files by an injected parser; a file that it cannot read yields one row with its error.

    A page is a dict with any of page_num, native_text, ocr_text or rec_texts (recognised lines), tables (dicts with
    markdown and html) and boxes (dicts with label and bbox).  A parser object may hold its engine: it is made once a
    worker process if it is a function with the attribute ``once``, which is then called without arguments.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser.once() if hasattr(parser, "once") else parser
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [page_row(path, i, p) for i, p in enumerate(parse(bytes(content)))]
                except Exception as error:  # noqa: BLE001  a broken file must not end the job
                    rows.append(error_row(path, error))
            yield pd.DataFrame(rows, columns=PAGE_COLUMNS)

    return files.mapInPandas(run, f"path string, {PAGE}")


def parsed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): ``pages`` written once, so that every file meets its parser once, and path and error of files
    that could not be read, each of which keeps one page without text."""
    rows = cut(pages)
    return rows, rows.where("error is not null").select("path", "error")


def page_tables(pages: DataFrame, published: bool = False) -> DataFrame:
    """``pages`` with ``tables``: the recognised tables of each page, numbered, blank ones left out."""
    found = F.filter(F.transform("found_tables", lambda t, i: M.table_result(t["markdown"], t["html"], F.col("page_num"), i, published)), lambda t: t.isNotNull())
    return pages.withColumn("tables", found)


def recognised(pages: DataFrame, source_col: str = "path") -> DataFrame:
    """Result of layout recognition per page: plain_text, markdown_text, tables, images, is_empty, char_count."""
    plain = F.coalesce("ocr_text", F.lit(""))
    images = F.transform(F.filter("boxes", lambda x: x["label"].isin("image", "figure")), lambda x: F.struct(x["bbox"].alias("bbox")))
    rows = page_tables(pages)
    parts = F.concat(F.when(plain != "", F.array(plain)).otherwise(F.array().cast("array<string>")), F.transform("tables", lambda t: t["markdown"]))
    return rows.select(
        source_col,
        "page_num",
        F.element_at(F.split(source_col, "/"), -1).alias("source_file"),
        F.array_join(parts, "\n\n").alias("markdown_text"),
        plain.alias("plain_text"),
        "tables",
        images.alias("images"),
        ((F.length(T.strip(plain)) < 10) & (F.size("tables") == 0)).alias("is_empty"),
        F.length(plain).alias("char_count"),
    )


def page_text(pages: DataFrame, layout: bool = False, doc_col: str = "path") -> DataFrame:
    """text, method, is_noise, tables per page.

    With a ``layout`` engine scanned documents take its text and tables for every page; all other documents take native
    text where there is enough of it, else recognised text, and have no tables.
    """
    rows = page_tables(pages)
    if layout:
        whole = scanned(pages, doc_col).select(F.col(doc_col).alias("__doc"), F.col("is_scanned").alias("__scanned"))
        rows = rows.join(whole, F.col(doc_col) == F.col("__doc"), "left").withColumn("engine", F.when(F.coalesce("__scanned", F.lit(False)), "layout").otherwise("page")).drop("__doc", "__scanned")
    else:
        rows = rows.withColumn("engine", F.lit("page"))
    by_layout = F.col("engine") == "layout"
    native = ~by_layout & (F.length(F.coalesce("native_text", F.lit(""))) > NATIVE_CHARS)
    raw = F.when(native, F.col("native_text")).otherwise(F.coalesce("ocr_text", F.lit("")))
    tables = F.when(by_layout, F.col("tables")).otherwise(F.array().cast(rows.schema["tables"].dataType))
    rows = rows.withColumns({"method": F.when(native, "native").when(by_layout, "layout").otherwise("ocr"), "text": T.clean(T.strip_page_frame(raw)), "tables": tables})
    return rows.withColumn("is_noise", T.is_noise(F.col("text")))


def image_text(pages: DataFrame) -> DataFrame:
    """The one page of each image: noise is judged on the cleaned text, before its first and last lines go."""
    first = page_tables(pages).where("page_num = 1 or error is not null")
    rows = first.withColumns({"method": F.lit("layout"), "engine": F.lit("layout"), "text": T.clean(F.coalesce("ocr_text", F.lit("")))})
    return rows.withColumn("is_noise", T.is_noise(F.col("text"))).withColumn("text", T.strip_page_frame(F.col("text")))


def scanned(pages: DataFrame, doc_col: str = "path") -> DataFrame:
    """doc, is_scanned: no native character on the first pages."""
    first = pages.where(F.col("page_num") <= SCAN_PAGES)
    return first.groupBy(doc_col).agg((F.sum(F.length(T.strip(F.coalesce("native_text", F.lit(""))))) == 0).alias("is_scanned"))


def documents(pages: DataFrame, doc_col: str = "path") -> DataFrame:
    """One row per document: page_count, full_text (usable pages in order, joined by a blank line) and its tables."""
    usable = F.when(~F.col("is_noise") & (T.strip(F.col("text")) != ""), F.struct("page_num", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(usable)), lambda p: p["text"]), "\n\n")
    parts = [F.count("*").alias("page_count"), text.alias("full_text")]
    if "tables" in pages.columns:
        parts.append(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "tables"))), lambda p: p["tables"])).alias("tables"))
    return pages.groupBy(doc_col).agg(*parts)


def intermediate(spark: SparkSession, path: str) -> DataFrame:
    """Intermediate files: one JSON object per input with its chunks and tables.

    Files named *_intermediate.json hold one object each; a folder that ``write_intermediate`` made holds one per line.
    """
    rows = spark.read.schema(schemas.INTERMEDIATE).option("recursiveFileLookup", "true")
    whole = rows.option("multiLine", "true").option("pathGlobFilter", "*_intermediate.json").json(path)
    lines = spark.read.schema(schemas.INTERMEDIATE).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.json").json(path)
    return whole.unionByName(lines)


def triples(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A JSON array (or lines) of raw triples; ``most`` keeps the first rows in file order."""
    rows = spark.read.schema(schemas.TRIPLE_FILE).option("multiLine", "true").json(path).withColumn("seq", F.monotonically_increasing_id())
    return rows if most is None else rows.orderBy("seq").limit(most)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Training examples: text and triples."""
    return spark.read.schema(schemas.TRAINING).json(path)


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.txt").text(path)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def alias_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """category, standard, alias, ord from a nested JSON dictionary; a missing file gives an empty table."""
    empty = spark.createDataFrame([], schemas.ALIAS)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return empty
    text = spark.read.option("wholetext", "true").text(path)
    groups = F.from_json("value", "map<string,string>")
    rows = text.select(F.explode(groups).alias("category", "body")).select("category", F.from_json("body", "map<string,array<string>>").alias("names")).where("names is not null")
    rows = rows.select("category", F.posexplode(F.map_entries("names")).alias("ord", "e"))
    return rows.select("category", F.col("e.key").alias("standard"), F.explode_outer("e.value").alias("alias"), "ord")


def ontology(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entity or relation types (kind 'entity' or 'relation') as a dimension table: id and the declared fields."""
    fields = "struct<description:string,label:string,properties:map<string,string>>" if kind == "entity" else "struct<description:string,subject_type:string,object_type:string,category:string>"
    rows = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", f"map<string,{fields}>")).alias("id", "t")).select("id", "t.*")
    return rows if kind == "entity" else rows.withColumn("subject_types", F.split("subject_type", "/"))
