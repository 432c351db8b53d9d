"""The queries by name; each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilngraph import service
from kilngraph.functions import fixed_values as fixed
from kilngraph.functions import rules
from kilngraph.functions import tables as M
from kilngraph.functions import text as T
from kilngraph.lineage import cut, shared_root
from kilngraph.operators import chunking, documents, extraction, formulation, graph, linking, mentions, normalising, paths, training
from kilngraph.operators import queries as R
from kilngraph.operators import questions as L
from kilngraph.operators.patterns import Node, Step, match, shared
from kilngraph.operators.substrings import SubstringIndex
from kilngraph.plans import bind
from kilngraph.sources import readers
from kilngraph.plans.bind import table

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}
#: A reservoir of the bound graph.
_FIRST_RESERVOIR = "Reservoir_" + hashlib.md5("Reservoir:Customer#000000007水库".encode()).hexdigest()


def query(f: Query) -> Query:
    CATALOGUE[f.__name__] = f
    return f


def _listed(column: str) -> Column:
    return F.array_join(F.transform(F.col(column), lambda x: x.cast("string")), "¦")


# --- text ----------------------------------------------------------------------------------------------------------


@query
def clean_replace(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [("the", "THE"), ("there", "here"), ("|", ""), ("ing", "in'")]
    return table(spark, sf, "documents").select("doc_id", F.md5(T.fix_known_errors(F.col("text"), pairs).cast("binary")).alias("digest"))


@query
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.clean_lines(F.col("text")).alias("text"))


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("digest"))


@query
def noise_flag(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.is_noise(text).alias("is_noise"), T.keep_chunk(text).alias("keep"))


def _mixed(text: Column) -> Column:
    """Text with lines in Chinese: blanks between characters, dashes, garbled and meaningless lines, short lines."""
    return F.concat_ws("\n", F.lit("水 库\n调 度"), F.lit("\n\n—— 流域--"), F.lit("!!!!!!!!!!!!!!!!!!!!水"), F.lit("**"), F.lit("a"), F.translate(text, "abcdefgh", "水库调度流域河站"))


@query
def clean_text_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning of texts whose letters are partly Chinese characters."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(_mixed(F.col("text"))).cast("binary")).alias("digest"))


@query
def noise_flag_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """The noise test on Chinese and mixed texts, long and short, with and without numbers."""
    kind, text = F.col("doc_id") % 5, F.col("text")
    rows = table(spark, sf, "documents").select("doc_id", F.when(kind == 0, text).when(kind == 1, F.translate(text, "abcdefgh", "水库调度流域河站")).when(kind == 2, F.concat(F.lit("短 2020 "), "doc_id")).when(kind == 3, F.concat(F.repeat(F.lit("x1 "), (F.col("doc_id") % 50).cast("int")), F.lit("水"))).otherwise(F.translate(text, "z", "水")).alias("t"))
    return rows.select("doc_id", T.is_noise(F.col("t")).alias("is_noise"), T.keep_chunk(F.col("t")).alias("keep"))


@query
def solver_document_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole solver document of all brands for one year, one row per variable, constraint and value of a series."""
    constraints = formulation.format_constraints(bind.part_constraints(spark, sf))
    series = bind.nation_series(spark, sf, "p_brand").where("year = 1996")
    row = cut(formulation.solver_document(_brands(spark, sf), constraints, formulation.format_parameters(bind.part_parameters(spark, sf)), series, 1996))
    text = lambda *columns: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    variables = row.select(F.explode("variables").alias("x")).select(F.lit("variable").alias("part"), text("x.symbol", "x.name", "x.lower", "x.upper", "x.unit").alias("line"))
    rules = row.select(F.explode("constraints").alias("x")).select(F.lit("constraint").alias("part"), text("x.expression", "x.type", "x.description").alias("line"))
    values = row.select(F.explode("time_series").alias("entity", "of")).select("entity", F.explode("of").alias("indicator", "rows")).select("entity", "indicator", F.explode("rows").alias("x"))
    values = values.select(F.lit("series").alias("part"), text("entity", "indicator", "x.year", "x.value", "x.unit").alias("line"))
    return variables.unionByName(rules).unionByName(values).groupBy("part", "line").agg(F.count("*").alias("n"))


@query
def extract_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = T.numbers(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(n).alias("n"), F.coalesce(F.element_at(F.when(F.size(n) > 0, n), 1), F.lit(0.0)).alias("first"), F.coalesce(F.array_max(n), F.lit(0.0)).alias("largest"))


@query
def strip_frame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length(T.strip_page_frame(F.col("text"))).alias("n"))


@query
def chunk_force(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.force_split(F.col("text"), 500, 100)).alias("pos", "chunk"))
    return rows.select("doc_id", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query
def chunk_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.pieces(F.col("text"))).alias("pos", "piece"))


@query
def chunk_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.split_text(table(spark, sf, "documents").select("doc_id", "text"), size=800, overlap=100)
    return rows.select("doc_id", "chunk_index", "chunk_id", "char_count", F.md5(F.col("content").cast("binary")).alias("digest"))


@query
def chunk_short(spark: SparkSession, sf: str) -> DataFrame:
    """The default chunk size: texts that fit are one chunk as they are, all others are split."""
    return chunking.split_text(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "chunk_id", "char_count")


@query
def doc_renumber(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of their source: chunks of all pages are numbered through."""
    pages = table(spark, sf, "documents").select("source", "doc_id", "text")
    return chunking.split_pages(pages, "source", "doc_id").select("source", "doc_id", "chunk_id", "char_count")


@query
def chunk_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Default chunks with their content."""
    rows = chunking.split_text(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_id", "char_count", F.md5(F.col("content").cast("binary")).alias("digest"))


@query
def doc_renumber_whole(spark: SparkSession, sf: str) -> DataFrame:
    """doc_renumber with the content of the chunks."""
    pages = table(spark, sf, "documents").select("source", "doc_id", "text")
    return chunking.split_pages(pages, "source", "doc_id").select("source", "doc_id", "chunk_id", "char_count", F.md5(F.col("content").cast("binary")).alias("digest"))


@query
def allowed_chars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.allowed_only(F.col("text")).cast("binary")).alias("digest"))


@query
def table_context(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.table_context(F.col("url"), F.when(F.col("page_id") % 3 > 0, F.col("page_id"))).alias("context"))


# --- tables and markup ---------------------------------------------------------------------------------------------


@query
def html_list_items(spark: SparkSession, sf: str) -> DataFrame:
    items = F.regexp_extract_all("html", F.lit("(?is)<li[^>]*>(.*?)</li>"), 1)
    return table(spark, sf, "pages").select("page_id", F.posexplode(items).alias("pos", "item")).select("page_id", "pos", T.strip(F.regexp_replace("item", "<[^>]+>", "")).alias("item"))


@query
def html_table(spark: SparkSession, sf: str) -> DataFrame:
    return bind.part_tables(spark, sf).select("p_brand", M.html_to_markdown(F.col("html")).alias("markdown"))


@query
def md_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = bind.part_tables(spark, sf).select("p_brand", M.parse_markdown(F.col("markdown")).alias("t"))
    # What each row carries is narrow: no row of the result holds its whole table.
    rows = rows.select("p_brand", _listed("t.headers").alias("headers"), "t.row_count", "t.col_count", F.transform("t.rows", lambda r: F.array_join(r, "¦")).alias("rows"))
    return rows.select("p_brand", "headers", "row_count", "col_count", F.posexplode("rows").alias("pos", "cells"))


@query
def embed_units(spark: SparkSession, sf: str) -> DataFrame:
    return bind.part_tables(spark, sf).select("p_brand", M.embed_units(F.col("markdown")).alias("markdown"))


@query
def split_table(spark: SparkSession, sf: str) -> DataFrame:
    return bind.part_tables(spark, sf).select("p_brand", F.posexplode(M.split_rows(F.col("markdown"), 3)).alias("pos", "part"))


# --- extraction ----------------------------------------------------------------------------------------------------


@query
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    talk = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(talk.alias("talk"))
    return rows.select("conv_id", extraction.chat_prompt(extraction.fill_template('Extract {{"a": 1}} from: {text} .', "text", F.col("talk"))).alias("prompt"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers in every shape: array, fenced, object, prose before it; one triple each, and one without an object."""
    # Dealt out, as a file of few row groups would leave the reading of all answers to as many tasks.
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props").repartition("event_id")
    item = F.concat(F.lit('{"subject": "u'), "user_id", F.lit('", "relation": "'), "event_type", F.lit('", "object": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    array = F.concat(F.lit("["), item, F.lit(', {"subject": "x", "relation": "y", "object": " "}]'))
    shape = F.element_at(F.array(array, F.concat(F.lit("```json\n"), array, F.lit("\n```")), F.concat(F.lit('{"triplets": '), array, F.lit("}")), F.concat(F.lit("Here they are: "), array)), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select("event_id", shape.alias("response"))


@query
def json_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf).select("event_id", F.explode(extraction.parse_response(F.col("response"))).alias("t"))
    return rows.select("event_id", "t.subject", "t.relation", "t.object", "t.confidence", "t.data_type")


@query
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of every shape, cut off in the second item: the first survives; the second has no object and goes."""
    cut = F.substring("response", F.lit(1), F.length("response") - F.element_at(F.array(F.lit(2), F.lit(12), F.lit(30)), (F.col("event_id") % 3 + 1).cast("int")))
    rows = _answers(spark, sf).select("event_id", F.explode(extraction.parse_response(cut)).alias("t"))
    return rows.select("event_id", "t.subject", "t.relation", "t.object")


@query
def json_repair_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """json_repair with the shape of the answer."""
    return json_repair(spark, sf).withColumn("shape", (F.col("event_id") % 4).cast("int"))


@query
def page_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.recognised(bind.file_pages(spark, sf))
    return rows.select("source_file", "page_num", "is_empty", "char_count", F.size("tables").alias("n_tables"), F.size("images").alias("n_images"), F.md5(F.col("markdown_text").cast("binary")).alias("markdown"))


@query
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of scanned files with their ids and counts."""
    rows = readers.page_text(bind.file_pages(spark, sf), layout=True).select("path", "method", F.explode("tables").alias("t"))
    return rows.select("path", "method", "t.table_id", "t.page_num", _listed("t.headers").alias("headers"), "t.row_count", "t.col_count")


@query
def page_method(spark: SparkSession, sf: str) -> DataFrame:
    """Native text where a document is not scanned, layout recognition for every page of one that is."""
    rows = readers.page_text(bind.file_pages(spark, sf), layout=True)
    return rows.select("path", "page_num", "engine", "method", "is_noise")


@query
def docs_to_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Files to pages and tables, chunks, prompts, recorded answers and raw triples with provenance."""
    pages, _ = readers.parsed(bind.file_pages(spark, sf))
    files = documents.intermediate(cut(readers.page_text(pages, layout=True)))
    rows = documents.extract(files, bind.recorded_answers)
    return rows.select("source_file", "page_num", "table_id", "data_type", "subject", "relation", "object", "confidence")


@query
def limit_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return extraction.limit_per_file(rows, 2, "conv_id", "turn")


# --- linking -------------------------------------------------------------------------------------------------------


@query
def alias_index(spark: SparkSession, sf: str) -> DataFrame:
    return bind.alias_index(spark, sf)


@query
def link_exact_alias(spark: SparkSession, sf: str) -> DataFrame:
    names = bind.raw_triples(spark, sf).select("seq", F.col("subject").alias("name"))
    return linking.link(names, bind.alias_index(spark, sf)).select("seq", "standardized", "matched", "method", "confidence")


@query
def link_triples(spark: SparkSession, sf: str) -> DataFrame:
    rows = linking.link_triples(bind.raw_triples(spark, sf), bind.alias_index(spark, sf))
    return rows.select("seq", "subject", "object", "original_subject", "subject_link_confidence", "object_link_confidence")


@query
def link_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against one anchor per label, the vector with the smallest id."""
    vectors = table(spark, sf, "embeddings")
    anchors = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    rows = linking.link_by_vector(vectors, anchors, "vec_id", "embedding", "label", threshold=0.3)
    return rows.select("vec_id", "best_name", F.round("similarity", 6).alias("similarity"))


# --- normalisation -------------------------------------------------------------------------------------------------


@query
def rel_match(spark: SparkSession, sf: str) -> DataFrame:
    return normalising.match_relation(bind.raw_triples(spark, sf)).select("seq", "relation_id", "rel_confidence", "is_annual", "rel_method")


@query
def entity_type(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("subject")
    return bind.raw_triples(spark, sf).select("seq", rules.subject_type(name).alias("type"), rules.node_label(name).alias("label"))


@query
def year_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalising.match_relation(bind.raw_triples(spark, sf))
    return rows.select("seq", normalising.determine_year(F.col("relation"), F.col("source_file"), F.col("is_annual")).alias("year"))


@query
def classify_object(spark: SparkSession, sf: str) -> DataFrame:
    return bind.raw_triples(spark, sf).select("seq", normalising.classify_object(F.col("object")).alias("kind"), normalising.has_number(F.col("object")).alias("numeric"))


@query
def normalise_triples(spark: SparkSession, sf: str) -> DataFrame:
    return bind.normalised(spark, sf).select("seq", "part", "subject", "subject_type", "relation_id", "object", "object_type", "year", "confidence", "rel_method")


@query
def dedupe_triples(spark: SparkSession, sf: str) -> DataFrame:
    return normalising.deduplicate(bind.normalised(spark, sf)).select("seq", "part", "subject", "relation", "object", "year", "confidence")


@query
def match_rate(spark: SparkSession, sf: str) -> DataFrame:
    return normalising.match_rate(bind.raw_triples(spark, sf))


@query
def norm_stats(spark: SparkSession, sf: str) -> DataFrame:
    return normalising.statistics(bind.raw_triples(spark, sf), bind.normalised(spark, sf))


@query
def norm_report(spark: SparkSession, sf: str) -> DataFrame:
    return normalising.report(bind.triples(spark, sf)).select("dimension", "value", "n", "rank")


# --- graph ---------------------------------------------------------------------------------------------------------


@query
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_nodes(bind.triples(spark, sf), digits=32)


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_edges(bind.triples(spark, sf), digits=32)


@query
def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as known nodes, their orders' totals as an update for every second one, and suppliers as new ones."""
    old = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value"))
    new = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("new "), "c_mktsegment").alias("value"))
    added = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("value"))
    store = bind.new_store(spark)
    store.write_full(old, bind.no_edges(spark))
    store.append(new.unionByName(added), bind.no_edges(spark))
    return store.nodes()


@query
def upsert_edges(spark: SparkSession, sf: str) -> DataFrame:
    """New edges overwrite equal keys and need both ends."""
    old = bind.edges(spark, sf)
    nodes = bind.nodes(spark, sf).where("label <> 'River'")
    new = old.where("year is not null").withColumn("confidence", F.lit(1.0)).select(graph.EDGE_COLUMNS)
    store = bind.new_store(spark)
    store.write_full(nodes, old.select(graph.EDGE_COLUMNS))
    store.append(nodes.limit(0), new)
    return store.edges().select("src", "rel", "dst", "year", "confidence")


@query
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.counts(bind.nodes(spark, sf), bind.edges(spark, sf), fixed.STAT_LABELS)


@query
def graph_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return graph.counts(bind.nodes(spark, sf), bind.edges(spark, sf))


# --- graph queries -------------------------------------------------------------------------------------------------


@query
def neighbors_collect(spark: SparkSession, sf: str) -> DataFrame:
    """Every reservoir with its relations in one list."""
    rows = R.neighbours(bind.nodes(spark, sf), bind.edges(spark, sf), label="Reservoir")
    lines = F.array_sort(F.transform("relations", lambda r: F.concat_ws(">", r["rel"], r["t_label"], r["t_name"])))
    return rows.select("id", "name", F.array_join(lines, "¦").alias("relations"))


@query
def linked_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """The constraints behind one reservoir, by id."""
    return R.linked_to(bind.nodes(spark, sf), bind.edges(spark, sf), _FIRST_RESERVOIR, "Constraint").select("rel", "relation_id", "confidence", "t_name", "t_value")


@query
def zone_names(spark: SparkSession, sf: str) -> DataFrame:
    return service.GraphService(bind.nodes(spark, sf), bind.edges(spark, sf)).zones()


@query
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.search_names(bind.nodes(spark, sf), "#00000001", "Reservoir").select("id", "name")


@query
def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    """How many node names hold each of many keywords, long and short, and the first of them, through the gram index."""
    index = SubstringIndex.build(bind.nodes(spark, sf), f"{shared_root(spark)}/grams-{uuid.uuid4().hex}")
    return index.summary(bind.keywords(spark, sf)).withColumnRenamed("first_text", "first_name")


@query
def pattern_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of all nodes whose name holds a word, by phrase and years, newest first."""
    rows = match(bind.nodes(spark, sf), bind.edges(spark, sf), [Node(contains="NATION_1"), Step(contains=("供水", "用水"), years=(1995, 1996, 1997)), Node()])
    return rows.select(F.col("n0_name").alias("entity"), F.col("e1_rel").alias("phrase"), F.coalesce("n2_value", "n2_name").alias("value"), F.col("e1_year").alias("year"))


@query
def pattern_shared_river(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a reservoir and a station on one river, and how many such rivers there are."""
    rows = shared(bind.nodes(spark, sf), bind.edges(spark, sf), Node(label="Reservoir"), Node(label="HydrologicalStation"), Node(label="River"), Step(contains="所在河流"))
    return rows.select(F.col("left").alias("reservoir"), F.col("right").alias("station"), F.col("n").alias("rivers"))


@query
def pattern_reachable(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and the world within three hops of every supplier, up the star schema."""
    edges = bind.star_edges(spark, sf)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumns({"label": F.substring("id", 1, 1), "name": F.col("id")})
    rows = match(nodes, edges, [Node(label="S"), Step(hops=(2, 3)), Node(label=("R", "W"))])
    return rows.select(F.col("n0_id").alias("supplier"), F.col("n2_id").alias("place"), "e1_hops")


@query
def label_scan(spark: SparkSession, sf: str) -> DataFrame:
    return R.scan_label(bind.nodes(spark, sf), "HydrologicalStation").select("id", "name")


@query
def reservoir_list(spark: SparkSession, sf: str) -> DataFrame:
    return R.list_with_neighbours(bind.nodes(spark, sf), bind.edges(spark, sf), "Reservoir", ("River",), 200, fan_out=True)


@query
def entity_series(spark: SparkSession, sf: str) -> DataFrame:
    return R.series(bind.nodes(spark, sf), bind.edges(spark, sf), label="HydrologicalStation", indicator="供水").select("s_name", "year", "indicator", "value", "unit")


@query
def zone_series(spark: SparkSession, sf: str) -> DataFrame:
    return R.series(bind.nodes(spark, sf), bind.edges(spark, sf), label="WaterResourceZone", year=1997, most=500).select("s_name", "year", "indicator", "value")


@query
def triple_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.search_triples(bind.nodes(spark, sf), bind.edges(spark, sf), "NATION_7").select("subject", "predicate", "object", "confidence")


@query
def trace_document(spark: SparkSession, sf: str) -> DataFrame:
    return R.trace_document(bind.nodes(spark, sf), bind.edges(spark, sf), "bulletin_1996.pdf").select("subject", "predicate", "object", "confidence", "context")


@query
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = paths.shortest_paths(bind.star_edges(spark, sf), "C1", "S2", depth=6)
    return rows.select(F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"), "depth")


@query
def constraints_union(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = bind.nodes(spark, sf), bind.edges(spark, sf)
    rows = R.constraints_of(nodes, edges, None, fixed.CONSTRAINT_WORDS, fixed.ANNUAL_WORDS)
    rows = rows.join(nodes.where("label = 'Reservoir'").select(F.col("id").alias("of")), F.col("src") == F.col("of"), "left_semi")
    return rows.select("src", "rel", "relation_id", "t_label", "t_name", "year")


@query
def params_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.parameters_of(bind.nodes(spark, sf), bind.edges(spark, sf))
    return rows.groupBy("src").pivot("key", formulation.PARAMETER_KEYS).agg(F.max("value"))


@query
def series_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.series_or_neighbours(bind.nodes(spark, sf), bind.edges(spark, sf), ["降水"], most=10)
    return rows.select("entity", "station", "year", "value")


def _river_of_suppliers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, entities): every supplier names another one as its neighbour at a distance."""
    supplier = table(spark, sf, "supplier")
    nodes = supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("Reservoir").alias("label"), F.col("s_name").alias("name")).unionByName(supplier.select(F.concat(F.lit("D"), "s_suppkey").alias("id"), F.lit("Constraint").alias("label"), F.col("s_acctbal").cast("string").alias("name")))
    other = F.format_string("Supplier#%09d", F.pmod(F.col("s_suppkey") * 7 + 3, F.lit(50)).cast("long"))
    edges = supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("D"), "s_suppkey").alias("dst"), F.concat(F.lit("上距"), other, F.lit("12km")).alias("rel"))
    return nodes, edges, supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"))


@query
def upstream_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that name a later supplier as their downstream neighbour at a distance."""
    return R.upstream_pairs(*_river_of_suppliers(spark, sf))


@query
def batch_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Upstream relations in any order of the entities, with names, as a batch formulation returns them."""
    nodes, edges, entities = _river_of_suppliers(spark, sf)
    pairs = R.upstream_pairs(nodes, edges, entities, symmetric=True)
    name = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
    rows = pairs.join(name("from"), F.col("upstream") == F.col("from_id")).join(name("to"), F.col("downstream") == F.col("to_id"))
    return rows.select("from_id", "from_name", "to_id", "to_name", F.lit("upstream").alias("relation"))


# --- formulation ---------------------------------------------------------------------------------------------------


@query
def categorize(spark: SparkSession, sf: str) -> DataFrame:
    return bind.part_constraints(spark, sf).select("ord", formulation.categorise(F.col("relation")).alias("category"))


@query
def operator_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("relation")
    return bind.part_constraints(spark, sf).select("ord", formulation.extract_operator(text).alias("meant"), formulation.extract_operator(text, published=True).alias("published"))


@query
def value_unit(spark: SparkSession, sf: str) -> DataFrame:
    parsed = formulation.extract_numeric(F.col("value"))
    return bind.part_constraints(spark, sf).select("ord", parsed["value"].alias("value"), parsed["unit"].alias("unit"))


@query
def constraint_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = formulation.format_constraints(bind.part_constraints(spark, sf))
    return rows.select("entity", "id", "name", "expression", "category", "variable", "operator", "value", "unit")


@query
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return formulation.bounds(formulation.format_constraints(bind.part_constraints(spark, sf)))


@query
def parameters(spark: SparkSession, sf: str) -> DataFrame:
    rows = formulation.format_parameters(bind.part_parameters(spark, sf))
    return rows.select("entity", F.col("dead_storage_level.value").alias("dead"), F.col("normal_storage_level.value").alias("normal"), F.col("total_capacity.value").alias("capacity"), F.col("total_capacity.unit").alias("unit"), F.col("flood_control_level.value").alias("flood"))


@query
def decision_vars(spark: SparkSession, sf: str) -> DataFrame:
    constraints = formulation.format_constraints(bind.part_constraints(spark, sf))
    return formulation.decision_variables(constraints, formulation.format_parameters(bind.part_parameters(spark, sf))).select("entity", "symbol", "unit", "lower", "upper")


@query
def objectives(spark: SparkSession, sf: str) -> DataFrame:
    return formulation.objective_candidates(formulation.format_constraints(bind.part_constraints(spark, sf)))


def _brands(spark: SparkSession, sf: str) -> DataFrame:
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("id")).distinct()
    return brands.select("id", F.concat(F.lit("name of "), "id").alias("name"), F.row_number().over(Window.orderBy("id")).alias("ord"))


@query
def solver_variables(spark: SparkSession, sf: str) -> DataFrame:
    constraints = formulation.format_constraints(bind.part_constraints(spark, sf))
    return formulation.solver_ready(_brands(spark, sf), constraints, formulation.format_parameters(bind.part_parameters(spark, sf)))[0]


@query
def solver_constraints(spark: SparkSession, sf: str) -> DataFrame:
    constraints = formulation.format_constraints(bind.part_constraints(spark, sf))
    return formulation.solver_ready(_brands(spark, sf), constraints, formulation.format_parameters(bind.part_parameters(spark, sf)))[1]


@query
def compare_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return formulation.compare(_brands(spark, sf), formulation.format_parameters(bind.part_parameters(spark, sf)), [f"name of Brand#{i}" for i in range(1, 26)])


def _shown(column: str, *parts: str) -> Column:
    """A nested list as text: the named parts of each entry."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws("|", *[x[p].cast("string") for p in parts])), "¦").alias(column)


@query
def formulation_nested(spark: SparkSession, sf: str) -> DataFrame:
    """One row per brand with all parts of its formulation; lists are shown as text."""
    constraints, rules = formulation.format_constraints(bind.part_constraints(spark, sf)), R.dispatch_rules_of(*bind.part_rules(spark, sf))
    rows = formulation.formulate(_brands(spark, sf), constraints, formulation.format_parameters(bind.part_parameters(spark, sf)), bind.nation_series(spark, sf, "p_brand"), rules)
    return rows.select(
        "entity",
        F.col("problem_meta.name").alias("name"),
        _shown("constraints", "id", "expression", "category"),
        _shown("decision_variables", "symbol", "lower", "upper"),
        _shown("objective_candidates", "description", "direction"),
        F.col("parameters.total_capacity.value").alias("capacity"),
        F.col("time_series.count").alias("n_series"),
        F.size("dispatch_rules").alias("n_rules"),
    )


@query
def dispatch_rules(spark: SparkSession, sf: str) -> DataFrame:
    return formulation.dispatch_rules(R.dispatch_rules_of(*bind.part_rules(spark, sf))).select("entity", _shown("dispatch_rules", "name", "content", "applicable_period", "condition"))


@query
def solver_series(spark: SparkSession, sf: str) -> DataFrame:
    """Orders a year by nation and market segment as series of the nations."""
    nations = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    rows = formulation.solver_series(nations, bind.nation_series(spark, sf)).select("entity", "name", F.explode("time_series").alias("indicator", "entries"))
    return rows.select("entity", "name", "indicator", _shown("entries", "year", "value", "unit"))


@query
def solver_hints(spark: SparkSession, sf: str) -> DataFrame:
    return formulation.objective_hints(formulation.format_constraints(bind.part_constraints(spark, sf)))


@query
def solver_document(spark: SparkSession, sf: str) -> DataFrame:
    """The whole document of all brands for one year, by its sizes, hints and meta."""
    constraints = formulation.format_constraints(bind.part_constraints(spark, sf))
    series = bind.nation_series(spark, sf, "p_brand").where("year = 1996")
    row = formulation.solver_document(_brands(spark, sf), constraints, formulation.format_parameters(bind.part_parameters(spark, sf)), series, 1996)
    years = F.array_join(F.transform("meta.time_series_years", lambda y: y.cast("string")), ",")
    return row.select(F.size("variables").alias("n_variables"), F.size("constraints").alias("n_constraints"), F.size("time_series").alias("n_entities"), F.array_join("objective_hints", "¦").alias("hints"), "meta.reservoir_count", "meta.constraint_count", years.alias("years"))


# --- questions and training ----------------------------------------------------------------------------------------


@query
def nlq_answer(spark: SparkSession, sf: str) -> DataFrame:
    filler = L.keyword_filler(["NATION_7", "NATION_12"], ["供水", "降水"])
    return L.ask(bind.nodes(spark, sf), bind.edges(spark, sf), "1997年NATION_7供水多少？", filler)


@query
def question_slots(spark: SparkSession, sf: str) -> DataFrame:
    """A question about every customer: the longest node name, the longest indicator and the years in it."""
    rows = mentions.slots(bind.questions(spark, sf), bind.nodes(spark, sf), bind.indicators(spark), ["c_custkey"])
    return rows.select("c_custkey", "entity", "indicator", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query
def question_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts that answer each of these questions."""
    found = mentions.slots(bind.questions(spark, sf), bind.nodes(spark, sf), bind.indicators(spark), ["c_custkey"])
    return mentions.facts(bind.nodes(spark, sf), bind.edges(spark, sf), found, ["c_custkey"])


@query
def conversation_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The longest word of the benchmark that each turn of each conversation holds, anywhere in its text."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("name")).where(F.length("name") >= 6)
    return mentions.longest(table(spark, sf, "conversations"), words, ["conv_id", "turn"])


@query
def nlq_empty(spark: SparkSession, sf: str) -> DataFrame:
    filler = L.keyword_filler(["NATION_7"], ["供水"])
    return L.ask(bind.nodes(spark, sf), bind.edges(spark, sf), "2090年NATION_7供水多少？", filler)


@query
def training_examples(spark: SparkSession, sf: str) -> DataFrame:
    item = F.array(F.struct(F.concat(F.lit("u"), "user_id").alias("subject"), F.col("event_type").alias("relation"), F.get_json_object("props", "$.k").alias("object")))
    return table(spark, sf, "events").select("event_id", training.training_example(F.concat(F.lit("event "), "event_id"), item).alias("example"))


@query
def response_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words as tokens; everything before the second word's first repeat is masked."""
    tokens = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    rows = table(spark, sf, "benchmark").select("item_id", tokens.alias("tokens")).withColumn("marker", F.array(F.lit(2).cast("long"), F.lit(3).cast("long")))
    return training.mask_prompt(rows, "tokens", "marker").select("item_id", "resp_start", _listed("labels").alias("labels"))
