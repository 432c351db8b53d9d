"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

Terms are counted in one pass.  A language keeps the terms of at least ``LEAST_DOCS`` of its documents; their counts are
dealt into vocabulary chunks of bounded size and packed, per group (language and source) and chunk, into arrays.  Groups
are dealt into blocks.  Each packed row goes to the tasks of its block's row and column in the square of group blocks;
a task (block by block, and a span of the vocabulary) goes through its chunks one after another and adds up its pair
submatrix.  A task holds two blocks of groups times one chunk as dense numbers, whatever the size of corpus, vocabulary
or group list.

All arithmetic is on whole numbers: a share of 10**9 is taken by long division, so it is exact for counts up to 9e15.

Defined cases: null texts, languages and sources count as empty strings; a group without terms has shares like any
other; where a language keeps no term all values are 0; a language with one source has no pairs; repeated rows count
each; an empty table gives an empty result; further columns are ignored, whatever their names; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm.storage import discard, materialise, slices

#: A term is kept by a language that has it in so many documents; ranks of the term report.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Groups of a block and terms of a chunk, on average; chunks of a task.
BLOCK_GROUPS, CHUNK_TERMS, SPAN_CHUNKS = 32, 1024, 8
#: Shares are of this whole.
WHOLE = 1_000_000_000
#: Languages, or groups, that are broadcast at most; with more the joins shuffle.
MOST_BROADCAST = 20_000

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def term_array(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """The terms of all texts, A-Z lower-cased, in order, and the number of the text of each."""
    _, offsets, data = texts.cast(pa.string()).buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]  # a text's first byte follows no other text
    at = np.flatnonzero(begins)
    number = np.searchsorted(offsets, at, side="right") - 1
    # Kept bytes lie side by side; a term ends where the next begins.
    kept = np.concatenate((np.cumsum(inside)[at] - 1, [inside.sum()])).astype(np.int32) if len(at) else np.zeros(1, np.int32)
    return number, pa.StringArray.from_buffers(len(at), pa.py_buffer(kept), pa.py_buffer(_FOLD[data[inside]]))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents with it); a row without term for each group seen."""
    for batch in batches:
        for part in slices(batch, "text"):
            group, first = _groups(part)
            number, terms = term_array(part.column("text"))
            coded = terms.dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, n = np.unique(number * size + coded.indices.to_numpy(), return_counts=True)
            keys, at = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
            total = np.bincount(at, n, minlength=len(keys)).astype(np.int64)
            docs = np.bincount(at, minlength=len(keys)).astype(np.int64)
            for rows, term, counts in (
                (first[keys // size], coded.dictionary.take(pa.array(keys % size)), (total, docs)),
                (first, pa.nulls(len(first), pa.string()), (np.zeros(len(first), np.int64),) * 2),
            ):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column("lang").take(take), part.column("source").take(take), term, pa.array(counts[0]), pa.array(counts[1])], ["lang", "source", "term", "n", "docs"])


def _groups(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each row, and the first row of each group."""
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    key = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return number, first


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * terms)), by long division in three steps of a thousand."""
    below = total + 2 * terms
    step = lambda rest: (F.call_function("div", rest * 1000, below), (rest * 1000) % below)
    a, rest = step(count + 2)
    b, rest = step(rest)
    c, _ = step(rest)
    return 1 + (a * 1000 + b) * 1000 + c


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """The same for a matrix of counts, a group a row."""
    below, rest, out = (totals + 2 * terms)[:, None], counts + 2, 0
    for _ in range(3):
        out = out * 1000 + rest * 1000 // below
        rest = rest * 1000 % below
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs over all documents; each group also has a row with a null term."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    found = rows.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _bounded(df: DataFrame, many: int) -> DataFrame:
    return F.broadcast(df) if many <= MOST_BROADCAST else df


def vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n of the kept terms, and ``first`` for one row of each term of a language."""
    term = Window.partitionBy("lang", "term")
    rows = counts.where("term is not null").withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return rows.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


class Audit:
    """Tables that both reports read: kept counts, groups and languages."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, **columns: str):
        self.counts = materialise(count_terms(docs, **columns), "divergence-counts")
        self.kept = materialise(vocabulary(self.counts, least_docs), "divergence-kept")
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = self.counts.where("term is null").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
        groups = materialise(groups, "divergence-groups")
        sizes = self.kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left")
        langs = materialise(langs.select("lang", "sources", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "divergence-langs")
        self.groups, self.langs = _bounded(groups, groups.count()), _bounded(langs, langs.count())

    def packed(self, chunk_terms: int, block_groups: int) -> DataFrame:
        """lang, source, block, blocks, total, terms, chunk, width, places, ns: a row for each group and chunk."""
        chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk_terms))
        terms = self.kept.where("first").join(self.langs, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), chunks).alias("chunk"))
        terms = terms.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
        terms = materialise(terms, "divergence-terms")
        widths = terms.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
        listed = self.kept.join(terms, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("x"))
        blocks = F.ceil(F.col("sources") / block_groups)
        every = self.groups.join(self.langs, "lang").where("sources > 1").select("lang", "source", "total", "terms", blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
        rows = every.join(listed, ["lang", "source", "chunk"], "left").join(widths, ["lang", "chunk"], "left")
        return rows.select("lang", "source", "block", "blocks", "total", "terms", "chunk", F.coalesce("width", F.lit(0)).alias("width"), F.col("x.place").alias("places"), F.col("x.n").alias("ns"))

    def pairs(self, chunk_terms: int = CHUNK_TERMS, block_groups: int = BLOCK_GROUPS, span_chunks: int = SPAN_CHUNKS) -> DataFrame:
        """lang, source, item, value: every ordered pair of sources of a language."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        tiles = self.packed(chunk_terms, block_groups).select("*", other.alias("other"))
        tiles = tiles.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.floor(F.col("chunk") / span_chunks).alias("span")).drop("blocks", "other")
        parts = tiles.groupBy("lang", "low", "high", "span").applyInArrow(_tile, "lang string, a string, b string, value long")
        sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        return sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")

    def over_represented(self, most: int = TOP_TERMS) -> DataFrame:
        """lang, source, item, value, rank: the terms that a group has more of than its language."""
        rows = self.kept.join(self.langs, "lang").join(self.groups, ["lang", "source"])
        rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
        rows = rows.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
        return ranked(rows).where(F.col("rank") <= most)

    def discard(self) -> None:
        discard(self.counts)


def ranked(rows: DataFrame) -> DataFrame:
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.withColumn("rank", F.row_number().over(group))


def _tile(table: pa.Table) -> pa.Table:
    """The pairs of two blocks of groups over one span of the vocabulary, chunk after chunk."""
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    table = table.combine_chunks()
    names = {}
    for source, block in zip(table.column("source").to_pylist(), table.column("block").to_pylist(), strict=True):
        names.setdefault(source, block)
    rows = sorted(s for s in names if names[s] == low)
    columns = rows if low == high else sorted(s for s in names if names[s] == high)
    sums = np.zeros((len(rows), len(columns)), np.int64)
    chunk = table.column("chunk").to_numpy()
    for c in np.unique(chunk) if rows and columns else ():
        part = table.filter(pa.array(chunk == c))
        by_name = _dense(part)
        p, q = (np.stack([by_name[s] for s in side]) for side in (rows, columns))
        for i in range(len(rows)):
            j = i + 1 if low == high else 0
            sums[i, j:] += ((p[i] - q[j:]) ** 2 // (p[i] + q[j:])).sum(1)
    a, b = np.triu_indices(len(rows), 1) if low == high else (x.ravel() for x in np.indices(sums.shape))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array([rows[i] for i in a], pa.string()), "b": pa.array([columns[i] for i in b], pa.string()), "value": pa.array(sums[a, b], pa.int64())})


def _dense(part: pa.Table) -> dict[str, np.ndarray]:
    """The shares of every term of a chunk, by source."""
    width, terms = part.column("width")[0].as_py(), part.column("terms")[0].as_py()
    counts = np.zeros((part.num_rows, width), np.int64)
    places, ns = part.column("places").combine_chunks(), part.column("ns").combine_chunks()
    lengths = np.nan_to_num(places.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    counts[np.repeat(np.arange(part.num_rows), lengths), places.flatten().to_numpy()] = ns.flatten().to_numpy()
    return dict(zip(part.column("source").to_pylist(), shares(counts, part.column("total").to_numpy(), terms), strict=True))


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, most_terms: int = TOP_TERMS, block_groups: int = BLOCK_GROUPS, chunk_terms: int = CHUNK_TERMS, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources by divergence, and each group's terms that stand out."""
    found = Audit(docs, least_docs, **columns)
    parts = {"pair": ranked(found.pairs(chunk_terms, block_groups)), "term": found.over_represented(most_terms)}
    one, two = (rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, rows in parts.items())
    found.discard()
    return one.unionByName(two)
