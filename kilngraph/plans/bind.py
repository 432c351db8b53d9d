"""Relational tables as the inputs that the operators expect: aliases, raw triples, normalised triples, a graph."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilngraph.lineage import cut, shared_root
from kilngraph.operators import extraction, graph, linking, normalising
from kilngraph.sources import readers
from kilngraph.sources.graph_store import GraphStore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as provinces (alias 'n<key>'), suppliers as stations (aliases 's<key>' and their name in capitals)."""
    nation = table(spark, sf_dir, "nation").select(F.lit("provinces").alias("category"), F.col("n_name").alias("standard"), F.concat(F.lit("N"), "n_nationkey").alias("alias"), F.col("n_nationkey").cast("int").alias("ord"))
    supplier = table(spark, sf_dir, "supplier")
    names = F.explode(F.array(F.concat(F.lit("s"), "s_suppkey"), F.upper("s_name")))
    return nation.unionByName(supplier.select(F.lit("hydrological_stations").alias("category"), F.col("s_name").alias("standard"), names.alias("alias"), F.col("s_suppkey").cast("int").alias("ord")))


def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.alias_index(aliases(spark, sf_dir))


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one triple; its key decides on subject, phrase and object form, so that every rule is met."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    # Dealt out, as a file of few row groups would leave the rules over all orders to as many tasks.
    rows = rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "c_name", "c_mktsegment", "n_nationkey", "r_name").repartition("o_orderkey")
    year, price = F.year("o_orderdate").cast("string"), F.col("o_totalprice").cast("long").cast("string")
    pick = lambda column, *values: F.element_at(F.array(*values), (column + 1).cast("int"))
    key = F.col("o_orderkey")
    subject = pick(F.col("o_custkey") % 7, F.concat("c_name", F.lit("水库")), F.concat("c_name", F.lit("水文站")), F.concat("c_name", F.lit("河")), F.concat(F.lit("n"), "n_nationkey"), F.col("c_name"), F.concat(F.lit("S"), F.col("o_custkey") % 10), F.concat("c_name", F.lit("以上")))
    relation = pick(
        key % 10, F.concat(year, F.lit("年供水量为")), F.lit("总库容为"), F.lit("死水位为"), F.lit("包括"), F.lit("上年降水量为"),
        F.lit("与1987~2016年均值相比径流偏少"), F.lit("placed by"), F.lit("所在河流为"), F.concat(F.lit("防洪限制水位不超过"), key % 500, F.lit("m")), F.lit("用水量合计总量为"),
    )
    obj = pick(
        key % 10, F.concat(price, F.lit("亿m³")), F.concat((key % 400).cast("string"), F.lit(".5亿m³")), F.concat((key % 3000).cast("string"), F.lit("m")), F.concat("c_mktsegment", F.lit("河、"), "r_name", F.lit("区，n"), "n_nationkey"), F.concat(price, F.lit("毫米")),
        F.concat((key % 100).cast("string"), F.lit("%")), F.lit("-"), F.concat("c_mktsegment", F.lit("河")), F.concat((key % 500).cast("string"), F.lit("m")), F.concat(price, F.lit("万m³")),
    )
    confidence = F.lit(0.5) + (key % 5).cast("double") / F.lit(10.0)
    return rows.select(key.alias("seq"), subject.alias("subject"), relation.alias("relation"), obj.alias("object"), F.col("o_orderpriority").alias("context"), confidence.alias("confidence"), F.concat(F.lit("bulletin_"), year, F.lit(".pdf")).alias("source_file"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalising.normalise(raw_triples(spark, sf_dir), alias_index(spark, sf_dir))


#: Graphs that this process has stored, by application and folder, with the state of the files they were built from.
_STORED: dict[tuple[str, str], tuple[str, tuple[DataFrame, DataFrame, DataFrame]]] = {}


def _files_state(spark: SparkSession, sf_dir: str, stored_tables: tuple[DataFrame, ...] = ()) -> str:
    """Sizes and times of the source files, and whether the stored tables are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(sf_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for name in ("orders", "customer", "nation", "region", "supplier"):
        where = path(f"{sf_dir}/{name}.parquet")
        parts.append(f"{system.getContentSummary(where).getLength()} {system.getFileStatus(where).getModificationTime()}")
    here = (path(t.work_folder) for t in stored_tables)
    return "; ".join(parts) + "".join(" gone" for p in here if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, nodes, edges) as written tables, as a graph store has them: built once, and again if anything changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORED and _STORED[key][0] == _files_state(spark, sf_dir, _STORED[key][1]):
        return _STORED[key][1]
    _STORED[key] = (_files_state(spark, sf_dir), build(spark, sf_dir))
    return _STORED[key][1]


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = cut(normalising.deduplicate(normalised(spark, sf_dir)))
    return facts, cut(graph.build_nodes(facts, digits=32)), cut(graph.build_edges(facts, digits=32))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)[0]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)[1]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)[2]


def new_store(spark: SparkSession) -> GraphStore:
    """An empty graph store in the shared work folder."""
    return GraphStore(spark, f"{shared_root(spark)}/graph-{uuid.uuid4().hex}")


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src string, rel string, dst string, year int")


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of one to many characters: names of nations, regions and segments, and ends of customers' and suppliers' names."""
    parts = [("nation", F.col("n_name")), ("region", F.col("r_name")), ("customer", F.col("c_mktsegment")), ("customer", F.right("c_name", F.lit(3))), ("supplier", F.right("s_name", F.lit(2))), ("supplier", F.right("s_name", F.lit(1))), ("customer", F.concat(F.right("c_name", F.lit(2)), F.lit("水")))]
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(c.alias("keyword")) for t, c in parts]).distinct()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, text: a question about every customer's reservoir or station."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("水库", "水文站", "河", "")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    what = F.element_at(F.array(*[F.lit(x) for x in ("供水量", "降水量", "总库容", "水位", "别的")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat((F.col("c_custkey") % 8 + 1992).cast("string"), F.lit("年"), "c_name", kind, F.lit("的"), what, F.lit("是多少？2001")).alias("text"))


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("供水", "供水量", "降水", "库容", "总库容", "位")], "name string")


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as a graph: world - region - nation - customer and supplier."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    rows = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.lit("belongs to").alias("rel"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    rows = rows.unionByName(customer.select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.lit("located in").alias("rel"), F.concat(F.lit("N"), "c_nationkey").alias("dst")))
    rows = rows.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("src"), F.lit("part of").alias("rel"), F.lit("W").alias("dst")))
    return rows.unionByName(supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.lit("located in").alias("rel"), F.concat(F.lit("N"), "s_nationkey").alias("dst")))


def part_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a constraint of its brand, in the shape that formulation expects."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    phrase = F.element_at(F.array(*[F.lit(x) for x in ("汛限水位不超过", "死水位不低于", "总库容为", "下泄流量不小于", "出力上限", "生态流量", "供水量保证")]), (key % 7 + 1).cast("int"))
    unit = F.element_at(F.array(*[F.lit(x) for x in ("m", "m", "亿m³", "m³/s", "万kW", "", "亿m³")]), (key % 7 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return part.select(F.col("p_brand").alias("entity"), key.alias("ord"), phrase.alias("relation"), none.alias("relation_id"), F.col("p_name").alias("name"), none.alias("variable"), none.alias("indicator"), none.alias("operator"), F.concat(F.col("p_size").cast("string"), unit).alias("value"), none.alias("unit"), none.alias("source_doc"), F.lit(0.9).alias("confidence"))


def part_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parameters per brand from its parts' sizes."""
    part = table(spark, sf_dir, "part")
    sizes = part.groupBy(F.col("p_brand").alias("entity")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.count("*").alias("n"))
    rows = F.array(
        F.struct(F.lit("dead_storage_level").alias("key"), F.concat(F.col("low").cast("string"), F.lit("m")).alias("value")),
        F.struct(F.lit("normal_storage_level").alias("key"), F.concat(F.col("high").cast("string"), F.lit("m")).alias("value")),
        F.struct(F.lit("total_capacity").alias("key"), F.concat(F.col("n").cast("string"), F.lit(".5亿m³")).alias("value")),
    )
    return sizes.select("entity", F.explode(rows).alias("p")).select("entity", "p.key", "p.value", F.lit(None).cast("string").alias("unit"))


def part_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): every part as a dispatch rule of its brand."""
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    nodes = part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.lit("DispatchRule").alias("label"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("规则"), "p_size")).alias("value"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("int")).alias("year"), none.alias("variable"))
    edges = part.select(F.col("p_brand").alias("src"), F.concat(F.lit("P"), "p_partkey").alias("dst"), F.lit("调度规则").alias("rel"), none.alias("source_doc"), F.lit(0.9).alias("confidence"))
    return nodes, edges


def nation_series(spark: SparkSession, sf_dir: str, entity: str | None = None) -> DataFrame:
    """Orders a year by nation and market segment; with ``entity`` 'p_brand', line items a year by brand."""
    if entity is not None:
        rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col(entity).alias("entity"), F.year("l_shipdate").alias("year"), F.lit("出货量").alias("indicator"))
    else:
        rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("N"), "c_nationkey").alias("entity"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("indicator"))
    return rows.groupBy("entity", "year", "indicator").agg(F.count("*").cast("string").alias("value")).withColumn("unit", F.lit("件"))


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown table per brand with its parts as rows, and its HTML form."""
    part = table(spark, sf_dir, "part")
    cells = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_size").cast("string").alias("s"))))
    rows = part.groupBy("p_brand").agg(cells.alias("c"))
    body = F.array_join(F.transform("c", lambda r: F.concat(F.lit("| "), r["n"], F.lit(" | "), r["s"], F.lit(" |"))), "\n")
    html = F.array_join(F.transform("c", lambda r: F.concat(F.lit("<tr><td>"), r["n"], F.lit("</td><td><b>"), r["s"], F.lit("</b></td></tr>"))), "")
    return rows.select("p_brand", F.concat(F.lit("| name | size(mm) |\n| --- | --- |\n"), body).alias("markdown"), F.concat(F.lit("<table><tr><th>name</th><th>size</th></tr>"), html, F.lit("</table>")).alias("html"))


# --- documents as files --------------------------------------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content: every conversation as a file of native pages, every brand as a scanned file with one table."""
    marker = F.concat(F.lit("记录"), "conv_id", F.lit("第"), "turn", F.lit("轮，供水量公报，水文站流域年度用水耗水统计结果登记备查"))
    page = F.concat(F.lit("页眉\n"), F.coalesce("text", F.lit("")), F.lit("\n"), marker, F.lit("\n页脚"))
    # Every third page has next to no native text, so its recognised text counts.
    poor = (F.col("conv_id") + F.col("turn")) % 3 == 0
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(poor, F.lit("扫描")).otherwise(page).alias("native_text"), F.when(poor, page).alias("ocr_text"))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("ocr_text", "native_text").alias("order"), "native_text", "ocr_text"))), lambda p: F.struct(p["native_text"].alias("native_text"), p["ocr_text"].alias("ocr_text")))
    talks = turns.groupBy("conv_id").agg(pages.alias("pages")).select(F.concat(F.lit("talks/conv_"), "conv_id", F.lit(".json")).alias("path"), F.to_json(F.struct("pages")).alias("content"))
    lines = F.concat(F.lit("页眉\n"), "p_brand", F.lit("材料尺寸清单，以毫米计，供各地校核登记使用\n页脚"))
    tables = F.array(F.struct(lines.alias("ocr_text"), F.array(F.struct(F.lit("image").alias("label"), F.array(F.lit(0.0), F.lit(1.0)).alias("bbox")), F.struct(F.lit("text").alias("label"), F.array(F.lit(2.0)).alias("bbox"))).alias("boxes"), F.array(F.struct(F.col("markdown").alias("markdown"), F.lit(None).cast("string").alias("html"))).alias("tables")))
    brands = part_tables(spark, sf_dir).select(F.concat(F.lit("tables/"), "p_brand", F.lit(".pdf")).alias("path"), F.to_json(F.struct(tables.alias("pages"))).alias("content"))
    return talks.unionByName(brands).select("path", F.col("content").cast("binary").alias("content"))


def recorded_pages(content: bytes) -> list[dict]:
    """The pages of a file of ``document_files``."""
    return json.loads(content)["pages"]


def recorded_answers(prompts: list[str], max_tokens: int) -> list[str]:
    """Answers recorded for the prompts of these files: one triple per marked page, one per data row of a table."""
    out = []
    for prompt in prompts:
        lines = [x for x in prompt.split("\n") if x.startswith("| ") and "---" not in x]
        rows = [[c.strip() for c in x.strip("|").split("|")] for x in lines[1:]] if max_tokens == extraction.TABLE_TOKENS else []
        marks = re.findall(r"记录(\d+)第(\d+)轮", prompt) if max_tokens == extraction.TEXT_TOKENS else []
        found = [(r[0], "尺寸为", r[1]) for r in rows] + [(f"记录{c}", "2024年供水量为", f"{t}亿m³") for c, t in marks]
        out.append(json.dumps([dict(zip(("subject", "relation", "object"), x, strict=True)) for x in found], ensure_ascii=False))
    return out


def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_pages(document_files(spark, sf_dir), recorded_pages)
