"""Path patterns over a graph as DataFrame plans: nodes and relations with typed filters, joined step by step.

    match(nodes, edges, [Node(label="Reservoir", contains="甲"), Step(contains="供水", years=(2020,)), Node()])

gives one row per match, with the columns of every part under its position (n0_id, n0_name, ..., e1_rel, e1_year, ...,
n2_id, ...).  A step may be walked against its direction (``back``) or either way (``either``), or repeated (``hops``).

Filters reach the scans of both tables, as each part is filtered before it is joined; the end of the path with the
stronger filter begins, so a path is grown from few rows; Catalyst picks the join of every step.  A pattern is a value, no
text is parsed or executed, and nothing can be written.

Defined cases: an unknown label or phrase matches nothing; without filters all paths match; a node may occur twice on a
path; an edge is used once per walk of a repeated step's two-node stretch, as nodes of a repeated step are not revisited.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.lineage import cut
from kilngraph.operators.linking import bounded

NODE_SHOWN, EDGE_SHOWN = ("id", "label", "name", "value", "unit"), ("rel", "relation_id", "year", "confidence", "source_doc")


@dataclass(frozen=True)
class Node:
    label: str | tuple[str, ...] | None = None
    id: str | tuple[str, ...] | None = None
    name: str | None = None
    contains: str | None = None

    def weight(self) -> int:
        """How much its filters are expected to leave out."""
        return 8 * (self.id is not None) + 4 * (self.name is not None) + 2 * (self.contains is not None) + (self.label is not None)

    def filters(self) -> list[Column]:
        many = lambda x: [x] if isinstance(x, str) else list(x)
        out = [F.col("label").isin(many(self.label))] if self.label is not None else []
        out += [F.col("id").isin(many(self.id))] if self.id is not None else []
        out += [F.col("name") == self.name] if self.name is not None else []
        return out + ([F.contains("name", F.lit(self.contains))] if self.contains is not None else [])


@dataclass(frozen=True)
class Step:
    relation_ids: tuple[str, ...] = ()
    contains: str | tuple[str, ...] | None = None
    years: tuple[int, ...] = ()
    document: str | None = None
    back: bool = False
    either: bool = False
    hops: tuple[int, int] = (1, 1)

    def filters(self) -> list[Column]:
        out = [F.col("relation_id").isin(list(self.relation_ids))] if self.relation_ids else []
        words = () if self.contains is None else (self.contains,) if isinstance(self.contains, str) else self.contains
        out += [reduce(Column.__or__, [F.contains("rel", F.lit(w)) for w in words])] if words else []
        out += [F.col("year").isin(list(self.years))] if self.years else []
        return out + ([F.col("source_doc") == self.document] if self.document is not None else [])


def _having(df: DataFrame, filters: list[Column]) -> DataFrame:
    return reduce(DataFrame.where, filters, df)


def _sides(edges: DataFrame, step: Step, backwards: bool) -> DataFrame:
    """The step's edges as a (from), b (to) in the direction of the walk."""
    shown = [c for c in EDGE_SHOWN if c in edges.columns]
    mine = _having(edges, step.filters())
    ends = [("src", "dst"), ("dst", "src")]
    ends = ends if step.either else [ends[step.back != backwards]]
    parts = [mine.select(F.col(a).alias("a"), F.col(b).alias("b"), *shown) for a, b in ends]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].where("a <> b"))


def _stretch(sides: DataFrame, hops: tuple[int, int], shown: list[str]) -> DataFrame:
    """a, b of all walks of a repeated step, without revisiting a node; the last edge's columns, and how many hops."""
    walk = sides.where("a <> b").select("a", "b", *shown, F.array("a", "b").alias("seen"), F.lit(1).alias("hops"))
    out = [walk] if hops[0] <= 1 else []
    for n in range(2, hops[1] + 1):
        more = sides.select(F.col("a").alias("via"), F.col("b").alias("to"), *[F.col(c).alias(f"to_{c}") for c in shown])
        walk = walk.join(more, F.col("b") == F.col("via")).where(~F.array_contains("seen", F.col("to")))
        walk = walk.select("a", F.col("to").alias("b"), *[F.col(f"to_{c}").alias(c) for c in shown], F.array_append("seen", F.col("to")).alias("seen"), F.lit(n).alias("hops"))
        out += [walk] if n >= hops[0] else []
    return reduce(DataFrame.unionByName, out).drop("seen")


def match(nodes: DataFrame, edges: DataFrame, path: list[Node | Step]) -> DataFrame:
    """One row per match of ``path``: nodes at even places, steps at odd ones."""
    if len(path) % 2 == 0 or not all(isinstance(x, Step if i % 2 else Node) for i, x in enumerate(path)):
        raise ValueError("a path is a node, or nodes with steps between them")
    if any(not 1 <= x.hops[0] <= x.hops[1] for x in path[1::2]):
        raise ValueError("hops are a range from one up")
    backwards = path[-1].weight() > path[0].weight()
    places = list(range(len(path)))[:: -1 if backwards else 1]
    shown = [c for c in NODE_SHOWN if c in nodes.columns]

    def node(place: int) -> DataFrame:
        return _having(nodes, path[place].filters()).select(*[F.col(c).alias(f"n{place}_{c}") for c in shown])

    rows = node(places[0])
    for at in range(1, len(places), 2):
        here, step, there = places[at - 1], places[at], places[at + 1]
        sides = _sides(edges, path[step], backwards)
        columns = [c for c in sides.columns if c not in ("a", "b")]
        if path[step].hops != (1, 1):
            sides = _stretch(sides, path[step].hops, columns)
            columns = [*columns, "hops"]
        sides = sides.select("a", "b", *[F.col(c).alias(f"e{step}_{c}") for c in columns])
        rows = rows.join(sides, F.col(f"n{here}_id") == F.col("a")).drop("a").join(node(there), F.col("b") == F.col(f"n{there}_id")).drop("b")
    return rows


#: Ends of a block of ``shared``: a task forms the pairs of two blocks.
BLOCK = 2048


def _met(nodes: DataFrame, edges: DataFrame, end: Node, step: Step, middle: Node, side: str) -> DataFrame:
    """Names of the ends, the middle nodes that each meets, and the name's block among the names that meet the same ones."""
    rows = match(nodes, edges, [end, step, middle]).select(F.col("n0_name").alias(side), F.col("n2_id").alias("at")).distinct()
    rows = cut(rows.groupBy(side).agg(F.array_sort(F.collect_list("at")).alias(f"{side}_met")))
    blocks = bounded(cut(rows.groupBy(f"{side}_met").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{side}_blocks"))))
    rows = rows.join(blocks, f"{side}_met")
    return rows.withColumn(f"{side}_block", F.pmod(F.xxhash64(side), F.col(f"{side}_blocks")).cast("int"))


def shared(nodes: DataFrame, edges: DataFrame, left: Node, right: Node, middle: Node, step: Step) -> DataFrame:
    """left, right (names), n: pairs of ends with ``step`` to a common middle node, and how many such nodes there are.

    The same rows as a match of left, step, middle, the step back, right with a count of distinct middle nodes, but no pair
    is shuffled: names that meet the same middle nodes form a class, counts are found between classes, and names meet
    last, block by block, so that a row per pair is formed only as it is returned.
    """
    met = {side: _met(nodes, edges, end, step, middle, side) for side, end in (("left", left), ("right", right))}
    classes = {side: cut(rows.select(f"{side}_met", f"{side}_blocks").distinct()) for side, rows in met.items()}
    a, b = (c.select("*", F.explode(f"{side}_met").alias("at")) for side, c in classes.items())
    counts = a.join(b, "at").groupBy("left_met", "left_blocks", "right_met", "right_blocks").agg(F.count("*").alias("n"))
    pairs = bounded(cut(counts.withColumn("pair", F.monotonically_increasing_id())))
    one = met["left"].select("left", "left_met", "left_block").join(pairs.select("pair", "n", "left_met", "right_blocks"), "left_met")
    two = met["right"].select("right", "right_met", "right_block").join(pairs.select("pair", "right_met", "left_blocks"), "right_met")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    one = one.select("left", "n", "pair", "left_block", each("right_blocks").alias("right_block"))
    two = two.select("right", "pair", "right_block", each("left_blocks").alias("left_block"))
    # A hint, so that blocks are dealt to tasks however few bytes they have.
    return one.join(two.hint("shuffle_hash"), ["pair", "left_block", "right_block"]).select("left", "right", "n")
