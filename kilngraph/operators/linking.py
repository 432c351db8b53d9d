"""Entity linking by alias tables and by vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions.text import strip
from kilngraph.lineage import cut

#: An alias index of at most so many bytes by Spark's own estimate is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32_000_000
#: Cells of a vector index at most; anchors looked at for each of its centres; anchors and vectors of one task; vectors compared at a time; more than rounding errors.
MOST_CELLS, SAMPLE, PAGE_ANCHORS, SLICE_VECTORS, VISIT_ROWS, SLACK = 1024, 8, 4096, 16_384, 512, 1e-6


def bounded(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the optimiser's size estimate of ``df`` is small enough, else ``df`` as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


def alias_index(aliases: DataFrame, categories: list[str] = fixed.ALIAS_CATEGORIES) -> DataFrame:
    """key -> standard from rows (category, standard, alias, ord).

    A standard name maps to itself, the later category or entry overwriting an earlier entry of the same key; an alias is
    stripped and lower-cased and only fills keys that nothing before it has taken.
    """
    rank = F.array_position(F.lit(categories), F.col("category"))
    rows = aliases.where(F.col("category").isin(categories)).withColumn("rank", rank)
    names = rows.groupBy("standard").agg(F.min(F.struct("rank", "ord")).alias("at")).select(F.col("standard").alias("key"), "standard", F.lit(0).alias("kind"), F.col("at.rank").alias("rank"), F.col("at.ord").alias("ord"))
    other = rows.where("alias is not null").select(F.lower(strip(F.col("alias"))).alias("key"), "standard", F.lit(1).alias("kind"), "rank", "ord")
    best = Window.partitionBy("key").orderBy("kind", "rank", "ord")
    return names.unionByName(other).withColumn("n", F.row_number().over(best)).where("n = 1").select("key", "standard")


def override(index: DataFrame, extra: DataFrame) -> DataFrame:
    """Index with the rows (key, standard) of ``extra`` in place of what it had."""
    mine = extra.select(F.lower(strip(F.col("key"))).alias("key"), "standard")
    return mine.unionByName(index.join(mine.select("key"), "key", "left_anti"))


def link(names: DataFrame, index: DataFrame, name_col: str = "name") -> DataFrame:
    """Adds original, standardized, matched, method (exact, alias, none) and confidence to every row of ``names``.

    A raw key is tried first, then its lower-cased form; an empty name is 'none' with confidence 0 and no standard form.
    """
    side = bounded(index)
    name = strip(F.col(name_col))
    raw = side.select(F.col("key").alias("k_raw"), F.col("standard").alias("s_raw"))
    low = side.select(F.col("key").alias("k_low"), F.col("standard").alias("s_low"))
    rows = names.withColumn("original", name)
    rows = rows.join(raw, F.col("original") == F.col("k_raw"), "left").join(low, F.lower("original") == F.col("k_low"), "left")
    hit = F.coalesce("s_raw", "s_low")
    empty = F.coalesce(F.col("original"), F.lit("")) == ""
    method = F.when(empty | hit.isNull(), "none").when(F.col("s_raw") == F.col("original"), "exact").otherwise("alias")
    rows = rows.withColumns({"standardized": F.when(~empty, F.coalesce(hit, "original")), "matched": ~empty & hit.isNotNull(), "method": method})
    rows = rows.withColumn("confidence", F.when(F.col("method") == "exact", 1.0).when(F.col("method") == "alias", 0.95).otherwise(0.0))
    return rows.drop("k_raw", "s_raw", "k_low", "s_low")


def link_counts(linked: DataFrame) -> DataFrame:
    """total and matched over a result of ``link``."""
    return linked.agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"))


def encode(names: DataFrame, encoder: Callable[[list[str]], list[list[float]]], name_col: str = "name", vector_col: str = "embedding") -> DataFrame:
    """``names`` with vectors by an injected encoder, called over Arrow batches; null names are encoded as ''."""
    columns = names.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = encoder(frame[name_col].fillna("").tolist()) if len(frame) else []
            yield frame.assign(**{vector_col: [[float(x) for x in v] for v in vectors]})[[*columns, vector_col]]

    return names.mapInPandas(run, names.select("*", F.array().cast("array<float>").alias(vector_col)).schema)


def link_fuzzy(names: DataFrame, standards: DataFrame, encoder: Callable[[list[str]], list[list[float]]], name_col: str = "name", threshold: float = 0.75) -> DataFrame:
    """``link_by_vector`` of distinct names against distinct standard names (column standard), both encoded here."""
    mine = encode(names.select(name_col).where(F.col(name_col).isNotNull()).distinct(), encoder, name_col)
    anchors = encode(standards.select("standard").distinct(), encoder, "standard")
    return link_by_vector(mine, anchors.select(F.col("standard").alias("anchor_name"), "embedding"), name_col, "embedding", "anchor_name", threshold)


def link_triples(triples: DataFrame, index: DataFrame) -> DataFrame:
    """Subjects and objects replaced by their standard names, with the originals and link confidences.

    Missing or empty names are not looked up and keep confidence 1.
    """
    names = triples.select(F.explode(F.array("subject", "object")).alias("name")).where("name <> ''").distinct()
    linked = link(names, index).select("name", "standardized", "confidence")
    out = triples
    for c in ("subject", "object"):
        side = linked.select(F.col("name").alias(f"{c}_name"), F.col("standardized").alias(f"{c}_std"), F.col("confidence").alias(f"{c}_conf"))
        out = out.join(side, F.col(c) == F.col(f"{c}_name"), "left").withColumns({f"original_{c}": F.col(c), c: F.coalesce(f"{c}_std", c), f"{c}_link_confidence": F.coalesce(f"{c}_conf", F.lit(1.0))})
        out = out.drop(f"{c}_name", f"{c}_std", f"{c}_conf")
    return out


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v):
    """The vector over its length; a zero or null vector gives null."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def link_by_vector(vectors: DataFrame, anchors: DataFrame, id_col: str, vector_col: str, name_col: str, threshold: float = 0.75) -> DataFrame:
    """The most similar anchor of every vector by cosine: best_name, similarity and matched (similarity >= threshold); see ``VectorIndex``."""
    return VectorIndex(anchors, name_col, vector_col).search(vectors, id_col, vector_col, threshold)


class VectorIndex:
    """Anchor vectors in cells, for exact searches; built once, written below the shared work folder.

    A cell is the anchors nearest to one of about 2 sqrt(n) of them, with a radius.  A vector first meets the cell that may
    hold the nearest anchor by its bound (distance to the centre less the radius), then those cells alone whose bound is
    below the distance it has found.  Vectors and anchors meet in tasks of (cell, page of the cell's anchors, slice of its
    vectors), all of bounded size, where a matrix product compares them.  On clustered anchors few pairs are compared; on
    evenly scattered ones in many dimensions no bound excludes much and nearly all pairs are (``compared`` has the number).

    Defined cases: null, zero and otherwise long vectors match nothing (null name, similarity -2), as without anchors;
    equally similar anchors go by name; repeated rows each get their result.
    """

    def __init__(self, anchors: DataFrame, name_col: str, vector_col: str):
        self.spark = anchors.sparkSession
        side = anchors.select(F.col(name_col).alias("anchor"), unit_vector(F.col(vector_col)).alias("unit")).where("unit is not null")
        self.name_type = side.schema["anchor"].dataType.simpleString()
        side, self.compared = cut(side), 0
        many = side.count()
        cells = min(MOST_CELLS, 2 * math.isqrt(many) + 1)
        some = [r.unit for r in side.orderBy(F.xxhash64("anchor"), "anchor").limit(SAMPLE * cells).collect()]
        self.width = len(some[0]) if some else 0
        some = [u for u in some if len(u) == self.width]
        centres = _spread(np.array(some, np.float64).reshape(len(some), self.width), cells)
        self.side = cut(side.where(F.size("unit") == self.width).mapInArrow(_assign(centres), f"anchor {self.name_type}, unit array<double>, cell int, far double"))
        stats = {r.cell: r for r in self.side.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
        cells = sorted(stats)
        self.cells, self.centres = np.array(cells, np.int32), centres[cells] if cells else centres[:0]
        self.radii, self.sizes = np.array([stats[c].far for c in cells]), {c: stats[c].n for c in cells}

    def search(self, vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.75) -> DataFrame:
        rows = cut(vectors.select(F.col(id_col).alias("id"), unit_vector(F.col(vector_col)).alias("unit")).withColumn("row", F.monotonically_increasing_id()))
        usable = rows.where(F.size("unit") == self.width).select("row", "unit") if len(self.cells) else rows.where("false").select("row", "unit")
        visit = "row long, unit array<double>, cell int"
        homes = cut(usable.withColumn("cell", F.lit(-1)).withColumn("score", F.lit(-2.0)).mapInArrow(_visits(self.cells, self.centres, self.radii), visit))
        first = cut(self._meet(homes))
        others = homes.join(first.groupBy("row").agg(F.max("score").alias("score")), "row").select("row", "unit", "cell", "score")
        found = first.unionByName(self._meet(cut(others.mapInArrow(_visits(self.cells, self.centres, self.radii), visit))))
        best = found.groupBy("row").agg(F.min_by(F.struct("name", "score"), F.struct((-F.col("score")).alias("s"), "name")).alias("best"))
        out = rows.join(best, "row", "left").select(F.col("id").alias(id_col), F.col("best.name").alias("best_name"), F.coalesce("best.score", F.lit(-2.0)).alias("similarity"))
        return out.withColumn("matched", F.col("similarity") >= threshold)

    def _meet(self, visits: DataFrame) -> DataFrame:
        """row, name, score: the best anchor of each visited page."""
        counts = {r.cell: r["count"] for r in visits.groupBy("cell").count().collect()}  # MOST_CELLS at most
        self.compared += sum(n * self.sizes[c] for c, n in counts.items())
        plan = F.broadcast(self.spark.createDataFrame([(c, -(-self.sizes[c] // PAGE_ANCHORS), -(-n // SLICE_VECTORS)) for c, n in counts.items()], "cell int, pages int, slices int"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = visits.join(plan, "cell").select("row", "unit", "cell", every("pages").alias("page"), F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("slice"))
        right = self.side.join(plan, "cell").select("anchor", "unit", "cell", F.pmod(F.xxhash64("anchor"), F.col("pages")).cast("int").alias("page"), every("slices").alias("slice"))
        keys = ("cell", "page", "slice")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best, f"row long, name {self.name_type}, score double")


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(lists), 0))


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of unit vectors; by less than SLACK off."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * units @ centres.T))


def _spread(units: np.ndarray, many: int) -> np.ndarray:
    """At most ``many`` of the unit vectors, each the farthest from those before it, so that every cluster has one."""
    picked, far = [], np.full(len(units), np.inf)
    while len(picked) < min(many, len(units)) and far.max() > SLACK:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _distances(units, units[picked[-1:]])[:, 0])
    return units[picked]


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_matrix(batch.column("unit"), centres.shape[1]), centres)
            cell = far.argmin(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("unit"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["anchor", "unit", "cell", "far"])

    return run


def _visits(cells: np.ndarray, centres: np.ndarray, radii: np.ndarray):
    """The cell to begin with of vectors that have met none (-1); of others, the cells that may hold a better anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, VISIT_ROWS):
                batch = whole.slice(at, VISIT_ROWS)
                bounds = _distances(_matrix(batch.column("unit"), centres.shape[1]), centres) - radii - SLACK
                met, score = batch.column("cell").to_numpy(), batch.column("score").to_numpy()
                reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * score)) + SLACK
                wanted = (bounds <= reach[:, None]) & (cells[None, :] != met[:, None])
                fresh = np.flatnonzero(met < 0)
                wanted[fresh] = False
                wanted[fresh, bounds[fresh].argmin(1)] = True
                rows, columns = np.nonzero(wanted)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("unit").take(take), pa.array(cells[columns])], ["row", "unit", "cell"])

    return run


def _best(left: pa.Table, right: pa.Table) -> pa.Table:
    """The most similar anchor of a page for each vector of a slice, ties to the smaller name.

    The product picks anchors within rounding of the best; their similarity is added up in order, as elsewhere.
    """
    width = len(left.column("unit")[0]) if left.num_rows else 0
    if not (left.num_rows and right.num_rows):
        return pa.table({"row": pa.array([], pa.int64()), "name": pa.array([], right.schema.field("anchor").type), "score": pa.array([], pa.float64())})
    right = right.sort_by("anchor")
    units, anchors = _matrix(left.column("unit").combine_chunks(), width), _matrix(right.column("unit").combine_chunks(), width)
    picked, scores = np.zeros(len(units), np.int64), np.zeros(len(units))
    for at in range(0, len(units), VISIT_ROWS):
        part = units[at : at + VISIT_ROWS]
        product = part @ anchors.T
        near = product >= product.max(1, keepdims=True) - SLACK
        for i, row in enumerate(near):
            some = np.flatnonzero(row)
            exact = np.cumsum(part[i] * anchors[some], axis=1)[:, -1]
            picked[at + i], scores[at + i] = some[exact.argmax()], exact.max()
    return pa.table({"row": left.column("row"), "name": right.column("anchor").take(pa.array(picked)), "score": pa.array(scores)})
