"""Shortest paths by search from both ends: the smaller frontier grows by one join with the edges, until the two meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.lineage import cut

MAX_DEPTH, MOST_PATHS = 4, 5


def shortest_paths(edges: DataFrame, start: str, end: str, depth: int = MAX_DEPTH, most: int = MOST_PATHS) -> DataFrame:
    """Undirected shortest paths between two nodes: nodes, rels, depth; at most ``most`` in lexical order.

    Levels are found first, one row per reached node, so hubs do not multiply paths, and neither end's neighbourhood is
    searched deeper than needed.  Then the nodes that lie on a shortest path are found from the meeting nodes outwards, and
    from these at most ``most`` paths per level are built.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([([start], [], 0)], "nodes array<string>, rels array<string>, depth int")
    sides = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel")).where("a <> b").distinct()
    sides = cut(sides)
    searches = [_Search(spark, sides, start), _Search(spark, sides, end)]
    while sum(s.level for s in searches) < depth and all(s.size for s in searches):
        mine, other = sorted(searches, key=lambda s: s.size)
        if mine.grow(other):
            break
    else:
        return spark.createDataFrame([], "nodes array<string>, rels array<string>, depth int")
    found, ahead = sum(s.level for s in searches), searches[0].level
    meeting = cut(searches[0].fronts[-1].join(searches[1].fronts[-1].toDF("other"), F.col("node") == F.col("other"), "left_semi"))
    # Outwards from the meeting nodes: the nodes of each place on the way that lie on a shortest path.
    useful = {ahead: meeting}
    for search, step in ((searches[0], -1), (searches[1], 1)):
        for level in range(search.level - 1, 0, -1):
            place = level if step < 0 else found - level
            near = sides.join(useful[place - step].toDF("useful"), F.col("a") == F.col("useful"), "left_semi").select(F.col("b").alias("near"))
            useful[place] = cut(search.fronts[level].join(near, F.col("node") == F.col("near"), "left_semi"))
    useful[found] = searches[1].fronts[0]
    # Forwards: every beginning leads to the end, so the least ``most`` beginnings of each length are enough.
    paths = spark.createDataFrame([([start], [], start)], "nodes array<string>, rels array<string>, head string")
    for place in range(1, found + 1):
        steps = sides.join(useful[place].toDF("useful"), F.col("b") == F.col("useful"), "left_semi")
        paths = paths.join(steps, F.col("head") == F.col("a")).select(F.concat("nodes", F.array("b")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"), F.col("b").alias("head"))
        paths = paths.orderBy("nodes", "rels").limit(most)
    return paths.select("nodes", "rels", F.lit(found).alias("depth"))


class _Search:
    """What is reached from one end: a table of nodes per level."""

    def __init__(self, spark, sides: DataFrame, node: str):
        self.sides, self.level, self.size = sides, 0, 1
        self.fronts = [spark.createDataFrame([(node,)], "node string")]

    def grow(self, other: _Search) -> bool:
        """Add a level; whether it holds a node of the other side's last one."""
        front = self.fronts[-1].toDF("at")
        near = self.sides.join(front, F.col("a") == F.col("at"), "left_semi").select(F.col("b").alias("node")).distinct()
        # In an undirected search new nodes can only be old ones of the last two levels.
        for old in self.fronts[-2:]:
            near = near.join(old.toDF("old"), F.col("node") == F.col("old"), "left_anti")
        self.fronts.append(cut(near))
        self.level += 1
        met = other.fronts[-1].select(F.col("node").alias("other"), F.lit(1).alias("met"))
        self.size, both = self.fronts[-1].join(met, F.col("node") == F.col("other"), "left").agg(F.count("*"), F.count("met")).first()
        return both > 0
