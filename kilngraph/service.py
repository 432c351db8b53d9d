"""Programmatic service surface: the reads that a web layer would expose, as methods that return frames or envelopes."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.operators import formulation, graph, paths, queries, questions
from kilngraph.operators.substrings import SubstringIndex
from kilngraph.sources.graph_store import GraphStore

MOST_BATCH = 10


def envelope(data: Any = None, code: int = 200, message: str = "success") -> dict[str, Any]:
    return {"code": code, "message": message, "data": data}


def respond(read: Callable[[], Any]) -> dict[str, Any]:
    """The envelope of a read: 400 for a bad argument, 404 for nothing found, 503 without a store, 500 for all else."""
    try:
        data = read()
    except ValueError as error:
        return envelope(None, 400, str(error))
    except LookupError as error:
        return envelope(None, 404, str(error) or "not found")
    except (ConnectionError, FileNotFoundError) as error:
        return envelope(None, 503, f"the graph store is unavailable: {error}")
    except Exception as error:  # noqa: BLE001  a service answers whatever happens
        return envelope(None, 503 if "PATH_NOT_FOUND" in str(error) else 500, f"internal error: {error}"[:500])
    if isinstance(data, DataFrame):
        data = [r.asDict(recursive=True) for r in data.collect()]
    return data if isinstance(data, dict) and set(data) == {"code", "message", "data"} else envelope(data)


class GraphService:
    """Named reads over node and edge tables: a pair of frames, which are cached until ``close``, or a graph store.

    Over a store nothing is cached: a read that names nodes or a document reads the files of their buckets (``_near``), any
    other one the tables as the newest snapshot has them.  With an index of ``names`` over it (built when the store was
    written, see ``index_names``) searches read the postings of the keyword and the edges of what they find.
    """

    def __init__(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, store: GraphStore | None = None, names: SubstringIndex | None = None):
        self.store, self.names = store, names
        self._tables = None if store else (nodes.cache(), edges.cache())

    @property
    def nodes(self) -> DataFrame:
        return self.store.nodes() if self.store else self._tables[0]

    @property
    def edges(self) -> DataFrame:
        return self.store.edges() if self.store else self._tables[1]

    def _near(self, ids: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges that hold at least ``ids``, what leaves them, and the nodes there."""
        return self.store.around(ids) if self.store and ids else (self.nodes, self.edges)

    def close(self) -> None:
        """Let cached tables go."""
        for table in self._tables or ():
            table.unpersist()

    def __enter__(self) -> GraphService:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def index_names(self, root: str) -> GraphService:
        """This service with a substring index of the store's names, written to ``root``."""
        return GraphService(store=self.store, names=SubstringIndex.build(self.store.nodes(), root))

    # Lists and lookups -------------------------------------------------------------------------------------------
    def reservoirs(self, limit: int = 50) -> DataFrame:
        return queries.list_with_neighbours(self.nodes, self.edges, "Reservoir", ("River", "HydrologicalStation"), self._limit(limit, 200))

    def reservoir(self, node: str) -> dict[str, Any]:
        rows = [r.asDict(recursive=True) for r in queries.neighbours(*self._near([node]), node).take(1)]
        return envelope(rows[0]) if rows else envelope(None, 404, "not found")

    def search_reservoirs(self, name: str, limit: int = 20) -> DataFrame:
        if not name:
            raise ValueError("name must not be empty")
        nodes = self.nodes
        if self.store and self.names:
            found = self.names.search(name).select("key").distinct()
            nodes = self.store.nodes_among(found)
        return queries.search_names(nodes, name, "Reservoir", self._limit(limit, 100))

    def rules(self, node: str) -> DataFrame:
        return queries.linked_to(*self._near([node]), node, "DispatchRule")

    def raw_constraints(self, node: str) -> DataFrame:
        return queries.linked_to(*self._near([node]), node, "Constraint")

    def stations(self, limit: int = 50) -> DataFrame:
        return queries.scan_label(self.nodes, "HydrologicalStation", self._limit(limit, 200))

    def station_data(self, node: str, year: int | None = None, indicator: str | None = None) -> DataFrame:
        return queries.series(*self._near([node]), node, "HydrologicalStation", year, indicator)

    def zones(self) -> DataFrame:
        return self.nodes.where("label = 'WaterResourceZone'").select("name", "id").orderBy("name", "id")

    def zone_data(self, zone: str | None = None, year: int | None = None) -> DataFrame:
        return queries.series(*self._near([zone] if zone else None), zone, "WaterResourceZone", year)

    # Knowledge ---------------------------------------------------------------------------------------------------
    def search(self, keyword: str, limit: int = 50) -> DataFrame:
        if self.store and self.names:
            hit = self.names.search(keyword).select("key").distinct()
            edges = self.store.edges_touching(hit)
            return queries.triples_at(self.nodes, edges, hit, self._limit(limit, 200))
        return queries.search_triples(self.nodes, self.edges, keyword, self._limit(limit, 200))

    def trace(self, document: str, limit: int = 100) -> DataFrame:
        if self.store:
            edges = self.store.edges_of_document(document)
            return queries.trace_document(self.store.ends_of(edges), edges, document, self._limit(limit, 500))
        return queries.trace_document(self.nodes, self.edges, document, self._limit(limit, 500))

    def path(self, start: str, end: str, depth: int = paths.MAX_DEPTH) -> DataFrame:
        if not 1 <= depth <= 6:
            raise ValueError("depth must be from 1 to 6")
        return paths.shortest_paths(self.edges, start, end, depth)

    def stats(self) -> DataFrame:
        return graph.counts(self.nodes, self.edges, fixed.STAT_LABELS)

    # Optimisation ------------------------------------------------------------------------------------------------
    def optimisation_reservoirs(self) -> DataFrame:
        """Reservoirs that a formulation can be asked for; at most 100."""
        return self.reservoirs(100)

    def _entities(self, ids: list[str]) -> DataFrame:
        """id, name, ord of the listed nodes; a node that is missing is named by its id."""
        if not 0 < len(ids) <= MOST_BATCH:
            raise ValueError(f"from 1 to {MOST_BATCH} ids")
        spark = self.store.spark if self.store else self.nodes.sparkSession
        order = spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "wanted string, ord int")
        return order.join(self.store.nodes_with(ids) if self.store else self.nodes, F.col("id") == F.col("wanted"), "left").select(F.col("wanted").alias("id"), F.coalesce("name", "wanted").alias("name"), "ord")

    def constraints(self, ids: list[str], category: str | None = None, year: int | None = None) -> DataFrame:
        self._entities(ids)
        rows = queries.constraints_of(*self._near(ids), ids, fixed.CONSTRAINT_WORDS, fixed.ANNUAL_WORDS)
        rows = rows if year is None else rows.where(F.col("year") == year)
        order = Window.partitionBy("src").orderBy(F.col("t_label").desc(), "rel", "dst", "year")
        shaped = rows.select(F.col("src").alias("entity"), F.row_number().over(order).alias("ord"), F.col("rel").alias("relation"), "relation_id", F.col("t_name").alias("name"), F.col("t_variable").alias("variable"), F.col("t_indicator").alias("indicator"), F.lit(None).cast("string").alias("operator"), F.col("t_value").alias("value"), F.col("t_unit").alias("unit"), "source_doc", "confidence")
        done = formulation.format_constraints(shaped)
        return done if category is None else done.where(F.col("category") == category)

    def parameters(self, ids: list[str]) -> DataFrame:
        rows = queries.parameters_of(*self._near(ids), ids).withColumnRenamed("src", "entity")
        return formulation.format_parameters(rows)

    def hydrology(self, ids: list[str], words: list[str] | None = None, year: int | None = None) -> DataFrame:
        return queries.series_or_neighbours(self.nodes, self.edges, words, year).where(F.col("entity").isin(ids))

    def formulate(self, ids: list[str], include_hydrology: bool = True, include_rules: bool = True, year: int | None = None) -> DataFrame:
        """One nested row per entity; series and dispatch rules are left out on request."""
        series = self.hydrology(ids, year=year) if include_hydrology else None
        rules = queries.dispatch_rules_of(*self._near(ids), ids) if include_rules else None
        return formulation.formulate(self._entities(ids), self.constraints(ids, year=year), self.parameters(ids), series, rules)

    def formulate_one(self, node: str, **options: Any) -> dict[str, Any]:
        if self._near([node])[0].where(F.col("id") == node).isEmpty():
            raise LookupError(f"no node {node}")
        return self.formulate([node], **options).first().asDict(recursive=True)

    def formulate_batch(self, ids: list[str], include_hydrology: bool = True, include_rules: bool = True) -> dict[str, Any]:
        """Formulations by id, a stub for a missing node, and the upstream relations among the listed entities."""
        rows = {r.entity: r.asDict(recursive=True) for r in self.formulate(ids, include_hydrology, include_rules).collect()}
        who = self._entities(ids)
        names = {r.id: r.name for r in who.collect()}
        pairs = queries.upstream_pairs(self.nodes, self.edges, who).orderBy("upstream", "downstream").collect()
        relations = [{"from": p.upstream, "from_name": names[p.upstream], "to": p.downstream, "to_name": names[p.downstream], "relation": "upstream"} for p in pairs]
        return {"reservoirs": {i: rows[i] for i in ids}, "relations": relations}

    def solver_tables(self, ids: list[str]) -> tuple[DataFrame, DataFrame]:
        return formulation.solver_ready(self._entities(ids), self.constraints(ids), self.parameters(ids))

    def solver_ready(self, ids: list[str], year: int | None = None) -> DataFrame:
        """The solver's document; series come with a year."""
        series = self.hydrology(ids, year=year) if year is not None else None
        return formulation.solver_document(self._entities(ids), self.constraints(ids), self.parameters(ids), series, year)

    def compare(self, ids: list[str]) -> DataFrame:
        who = self._entities(ids)
        return formulation.compare(who, self.parameters(ids), [r.name for r in who.orderBy("ord").collect()])

    # Questions ---------------------------------------------------------------------------------------------------
    def ask(self, question: str, filler: questions.SlotFiller) -> dict[str, Any]:
        """Answer, number of rows, the plan that the question became, and seconds per step."""
        began = time.perf_counter()
        slots = filler(question)
        filled = time.perf_counter()
        rows = questions.plan(self.nodes, self.edges, slots)
        row = questions.answer(rows, question).first()
        done = time.perf_counter()
        timing = {"slots": round(filled - began, 2), "graph": round(done - filled, 2), "total": round(done - began, 2)}
        return envelope({"answer": row.answer, "rows": row.n_rows, "query": questions.described(slots), "timing": timing})

    def health(self) -> dict[str, Any]:
        return envelope({"status": "ok"})

    @staticmethod
    def _limit(limit: int, most: int) -> int:
        if not 1 <= limit <= most:
            raise ValueError(f"limit must be from 1 to {most}")
        return limit
