"""Command line: parse documents, extract triples, normalise, build or append to a graph store, report.

    python -m kilngraph documents --files FOLDER --parser MODULE:FUNCTION --out FOLDER [--images] [--layout] [--errors FOLDER]
    python -m kilngraph extract --intermediate FOLDER --model MODULE:FUNCTION --out FOLDER [--graph FOLDER] [--answers FOLDER] [--aliases FILE] [--limit N] [--mode full|append] [--dry-run]
    python -m kilngraph build --triples FILE --graph FOLDER [--aliases FILE] [--mode full|append] [--limit N] [--dry-run]
    python -m kilngraph report --triples FILE [--aliases FILE] [--limit N] [--out FOLDER] [--stats-only]
    python -m kilngraph stats --graph FOLDER
    python -m kilngraph clear --graph FOLDER --yes
    python -m kilngraph chunks --texts FOLDER --out FOLDER
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilngraph.functions import fixed_values as fixed
from kilngraph.lineage import cut
from kilngraph.operators import chunking, documents, graph, linking, normalising
from kilngraph.sources import answers, readers, sinks


def _hook(name: str) -> Callable:
    """The function that MODULE:FUNCTION names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _index(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    return linking.alias_index(readers.alias_dictionary(spark, args.aliases)) if args.aliases else None


def _normalised(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return normalising.deduplicate(normalising.normalise(readers.triples(spark, args.triples, args.limit), _index(spark, args)))


def _store(spark: SparkSession, args: argparse.Namespace, triples: DataFrame) -> None:
    """Write the graph, or with --dry-run only say what it would hold."""
    nodes, edges = graph.build_nodes(triples), graph.build_edges(triples)
    store = sinks.GraphStore(spark, args.graph)
    if args.dry_run:
        print(store.dry_run(nodes, edges))
    else:
        (store.write_full if args.mode == "full" else store.append)(nodes, edges)


def _documents(spark: SparkSession, args: argparse.Namespace) -> None:
    files = readers.binary_files(spark, args.files, readers.IMAGE_GLOB if args.images else readers.PDF_GLOB)
    found, errors = readers.parsed(readers.parse_pages(files, _hook(args.parser)))
    pages = cut(readers.image_text(found) if args.images else readers.page_text(found, layout=args.layout))
    sinks.write_intermediate(documents.intermediate(pages), args.out)
    if args.errors:
        sinks.write_json(errors, args.errors)
    errors.show(100, truncate=False)


def _extract(spark: SparkSession, args: argparse.Namespace) -> None:
    files = readers.intermediate(spark, args.intermediate)
    # Written once: a model is not to be asked again by a later step.
    store = answers.AnswerStore(spark, args.answers) if args.answers else None
    raw = cut(documents.extract(files, _hook(args.model), most_chunks=args.limit, store=store))
    rows, counters = normalising.observed(normalising.normalise(raw, _index(spark, args)))
    triples = cut(normalising.deduplicate(rows))
    print(counters.get)
    sinks.write_json(triples, f"{args.out}/by_file", by="source_file")
    sinks.write_json(triples, f"{args.out}/all")
    normalising.match_rate(raw).show()
    if args.graph:
        _store(spark, args, triples)


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = readers.triples(spark, args.triples, args.limit)
    triples = _normalised(spark, args)
    normalising.match_rate(raw).show()
    normalising.report(triples).orderBy("dimension", "rank").show(200, truncate=False)
    if args.out and not args.stats_only:
        sinks.write_json(triples, args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kilngraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("documents", "extract", "build", "report", "stats", "clear", "chunks"):
        sub = commands.add_parser(name)
        needed = {"documents": ["files", "parser", "out"], "extract": ["intermediate", "model", "out"], "build": ["triples", "graph"], "report": ["triples"], "stats": ["graph"], "clear": ["graph"], "chunks": ["texts", "out"]}
        for option in needed[name]:
            sub.add_argument(f"--{option}", required=True)
        if name in ("extract", "build", "report"):
            sub.add_argument("--aliases")
            sub.add_argument("--limit", type=int)
        if name in ("extract", "build"):
            sub.add_argument("--mode", choices=["full", "append"], default="full" if name == "build" else "append")
            sub.add_argument("--dry-run", action="store_true")
        if name == "extract":
            sub.add_argument("--graph")
            sub.add_argument("--answers")
        if name == "report":
            sub.add_argument("--out")
            sub.add_argument("--stats-only", action="store_true")
        if name == "documents":
            sub.add_argument("--images", action="store_true")
            sub.add_argument("--layout", action="store_true")
            sub.add_argument("--errors")
        if name == "clear":
            sub.add_argument("--yes", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("kilngraph").getOrCreate()

    if args.command == "documents":
        _documents(spark, args)
    elif args.command == "extract":
        _extract(spark, args)
    elif args.command == "build":
        _store(spark, args, cut(_normalised(spark, args)))
    elif args.command == "report":
        _report(spark, args)
    elif args.command == "stats":
        store = sinks.GraphStore(spark, args.graph)
        graph.counts(store.nodes(), store.edges(), fixed.STAT_LABELS).show(100, truncate=False)
    elif args.command == "clear":
        sinks.GraphStore(spark, args.graph).delete_all(confirm=args.yes)
    else:
        sinks.write_json(chunking.usable(chunking.split_text(readers.text_directory(spark, args.texts))), args.out, by="source_file")


if __name__ == "__main__":
    main()
