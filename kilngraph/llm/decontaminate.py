"""Benchmark decontamination with training suffix arrays.

Each task cuts its documents into shards of bounded text and builds, once per shard, a suffix array over all the shard's
words: the starts of all suffixes of all documents in full lexicographic order.  Words become small integers; as many of
them as fit are packed into one number, by which suffixes are sorted first; what is still equal is refined by doubling.
Every block of benchmark items is then searched in the arrays that are at hand, all its suffixes at once:

* Windows: binary search of every suffix that starts a window gives the range of suffixes that begin with it, hence every
  place where it occurs verbatim; these places are marked, and the items noted.
* Longest matches: every suffix of every item is binary-searched for its place in the array; a document's suffix then has
  its longest match with one of its two neighbours among them, however short it is.  The longest one of each document is
  reported with its item and both places.

Nothing is shuffled, and no text is written.  A benchmark of about ``BLOCK_BYTES`` of text is one block and travels as a
broadcast; a task then holds one shard at a time.  A larger one is cut into blocks of whole items, which lie as files in
the shared work folder; a task holds ``GROUP_SHARDS`` shards with their arrays and marks, and reads the blocks in turn.

Defined cases: null or empty texts have no words, no hits and are not contaminated; items without words have no window;
an item of fewer words than the window is one window; items with a null id mark words but are not listed; repeated rows
and items are treated alike; of equally long matches the first in the document counts, then the least item id and place
within a block, and the earlier block; an empty documents table gives an empty result, an empty benchmark gives no hit;
further columns are kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kilngraph.llm.storage import discard, materialise, new_folder, slices

WINDOW_WORDS = 13
#: A document is contaminated if hit words * HIT_FACTOR >= words.
HIT_FACTOR = 20
#: Text of a shard, shards that are searched together, and most benchmark text in one block.
SHARD_BYTES, GROUP_SHARDS, BLOCK_BYTES = 2_000_000, 12, 4_000_000
#: Words are runs of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z; on UTF-8 bytes this is one table.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_FOLDED = np.frombuffer(FOLD, np.uint8)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def word_array(texts: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray]:
    """The words of all texts in order, and how many each text has."""
    data = _FOLDED[np.frombuffer(b" ".join(texts), np.uint8)]
    inside = data != 0x20
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = np.flatnonzero(begins)
    # Word bytes lie side by side once the others are gone; a word ends where the next begins.
    offsets = np.append(np.cumsum(inside)[at] - 1 if len(at) else at, inside.sum()).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.diff(np.searchsorted(at, ends), prepend=0), found


def _known_ahead(tokens: np.ndarray) -> np.ndarray:
    """From each place, the number of tokens up to the next 0."""
    at = np.arange(len(tokens))
    stops = np.where(tokens == 0, at, len(tokens))
    return np.minimum.accumulate(stops[::-1])[::-1] - at


def _expand(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value in [begin, begin + size) of each row."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


class SuffixArray:
    """All suffixes of a token sequence in full order; a suffix ends before the next token 0, which matches nothing.

    ``bits`` is enough for any token of this and of the sequences it is compared with; ``per`` tokens are one key.
    """

    def __init__(self, tokens: np.ndarray, bits: int):
        self.tokens, self.bits, self.per = tokens, bits, max(1, 62 // bits)
        self.ahead = _known_ahead(tokens).astype(np.int32)
        self.keys = np.zeros(len(tokens) + 1, np.int64)
        for i in range(self.per):
            there = np.zeros(len(tokens), np.int64)
            alive = self.ahead > i
            there[alive] = tokens[np.flatnonzero(alive) + i]
            self.keys[:-1] |= there << (bits * (self.per - 1 - i))
        starts = np.flatnonzero(tokens)
        self.order = starts[np.argsort(self.keys[starts], kind="stable")].astype(np.int32)
        self._refine()
        self.first = self.keys[self.order]

    def _refine(self) -> None:
        """Sort suffixes that are equal so far by what follows, twice as far each time; ended ones stay equal."""
        order, keys, done = self.order, self.keys[self.order], self.per
        if not len(order):
            return
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank = np.zeros(len(self.tokens) + 1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) + 1
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        rows = np.flatnonzero(np.repeat(size, size) > 1)
        while True:
            rows = rows[self.ahead[order[rows]] >= done]  # the rest are whole suffixes, equal for good
            if not len(rows):
                return
            at = order[rows]
            group, after = rank[at], rank[np.minimum(at + done, len(self.tokens))]
            turn = np.lexsort((after, group))
            # Places of a group that are given anew: those of its members that go on, behind those that have ended.
            at, group, after = at[turn], group[turn], after[turn]
            order[rows] = at
            begin = np.concatenate(([True], group[1:] != group[:-1]))
            split = begin | np.concatenate(([True], after[1:] != after[:-1]))
            # A subgroup's rank is the place of its first member; the places are those in ``rows``, which keep their order.
            rank[at] = np.maximum.accumulate(np.where(split, rows, -1)) + 1
            many = np.diff(np.append(np.flatnonzero(split), len(rows)))
            rows = rows[np.repeat(many, many) > 1]
            done *= 2

    def key(self, at: np.ndarray, offset) -> np.ndarray:
        """The key of each suffix from ``offset`` on, 0 behind its end."""
        return np.where(offset < self.ahead[at], self.keys[np.minimum(at + offset, len(self.tokens))], 0)

    def _bisect(self, low: np.ndarray, high: np.ndarray, offset: int, key: np.ndarray, right: bool) -> np.ndarray:
        """In [low, high) the first suffix whose key from ``offset`` on is not below (or is above) ``key``."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            have = self.key(self.order[middle], offset)
            up = have <= key[open_] if right else have < key[open_]
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]

    def ranges(self, query: SuffixArray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) in ``order``: the suffixes that begin with the first ``depth`` tokens of query's suffixes ``at``."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        alive, offset = np.arange(len(at)), 0
        while len(alive):
            left = np.minimum(depth[alive] - offset, self.per)
            free = (np.int64(1) << (self.bits * (self.per - left))) - 1  # bits of tokens beyond the depth
            key = query.key(at[alive], offset) & ~free
            if offset:
                a = self._bisect(low[alive], high[alive], offset, key, False)
                b = self._bisect(low[alive], high[alive], offset, key | free, True)
            else:
                a, b = np.searchsorted(self.first, key), np.searchsorted(self.first, key | free, side="right")
            low[alive], high[alive] = a, b
            offset += self.per
            alive = alive[(b > a) & (depth[alive] > offset)]
        return low, high

    def places(self, query: SuffixArray, at: np.ndarray) -> np.ndarray:
        """Where in ``order`` query's suffixes ``at`` belong: the number of suffixes that sort before each."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        alive, offset = np.arange(len(at)), 0
        while len(alive):
            key = query.key(at[alive], offset)
            if offset:
                a = self._bisect(low[alive], high[alive], offset, key, False)
                b = self._bisect(low[alive], high[alive], offset, key, True)
            else:
                a, b = np.searchsorted(self.first, key), np.searchsorted(self.first, key, side="right")
            low[alive], high[alive] = a, b
            offset += self.per
            alive = alive[(b > a) & (query.ahead[at[alive]] >= offset)]
        return low

    def common(self, at: np.ndarray, other: SuffixArray, there: np.ndarray) -> np.ndarray:
        """How many tokens suffixes of both sequences have in common from their beginning."""
        most = np.minimum(self.ahead[at], other.ahead[there])
        out, alive, offset = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(alive):
            differ = self.key(at[alive], offset) ^ other.key(there[alive], offset)
            same = sum((differ >> (self.bits * (self.per - 1 - i)) == 0).astype(np.int64) for i in range(self.per))
            out[alive] += same
            offset += self.per
            alive = alive[(same == self.per) & (most[alive] > offset)]
        return np.minimum(out, most)


class Shard:
    """Documents as one sequence of word numbers with its suffix array, and what has been found in them."""

    def __init__(self, texts: list[bytes | None]):
        self.lengths, found = word_array([t or b"" for t in texts])
        coded = found.dictionary_encode()
        self.words = coded.dictionary
        self.ends = np.cumsum(self.lengths + 1)
        tokens = np.zeros(int(self.ends[-1]) if len(texts) else 0, np.int64)
        inside = np.ones(len(tokens), bool)
        inside[self.ends - 1] = False
        tokens[inside] = coded.indices.to_numpy().astype(np.int64) + 1
        self.array = SuffixArray(tokens, (len(self.words) + 1).bit_length())
        self.hit = np.zeros(len(tokens), bool)
        self.items: list[set[str]] = [set() for _ in texts]
        self.best: list[tuple] = [(0, -1, None, -1)] * len(texts)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def search(self, block: Benchmark) -> None:
        """Mark the windows of a block, note their items, and keep each document's longest match."""
        array = self.array
        number = pc.index_in(block.words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64) + 1
        query = SuffixArray(np.append(0, number)[block.tokens], array.bits)
        if not (len(query.order) and len(array.order)):
            return
        for size, at in block.starts.items():
            at = at[query.ahead[at] >= size]  # with a word that the shard lacks, a window occurs nowhere in it
            low, high = array.ranges(query, at, np.full(len(at), size))
            self._mark(block, at, low, high, size)
        self._longest(block, query)

    def _mark(self, block: Benchmark, at: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> None:
        some = np.flatnonzero(high > low)
        if not len(some):
            return
        # Equal windows find the same range; its places are marked once, for the items of all of them.
        ranges, one, which = np.unique(low[some], return_index=True, return_inverse=True)
        row, places = _expand(ranges, high[some][one] - ranges)
        places = self.array.order[places]
        change = np.bincount(places, minlength=len(self.hit) + 1) - np.bincount(places + size, minlength=len(self.hit) + 1)
        self.hit |= np.cumsum(change)[:-1] > 0
        owners: list[set[str]] = [set() for _ in ranges]
        for r, i in zip(which.reshape(-1).tolist(), block.item_of(at[some]).tolist(), strict=True):
            if block.items[i] is not None:
                owners[r].add(block.items[i])
        for r, d in np.unique(np.stack([row, self.document(places)], 1), axis=0).tolist():
            self.items[d] |= owners[r]

    def _longest(self, block: Benchmark, query: SuffixArray) -> None:
        """A suffix's longest match is with its neighbour before or behind it among all suffixes of the block."""
        array = self.array
        ahead = np.searchsorted(array.places(query, query.order), np.arange(len(array.order)), side="right")
        length = np.zeros(len(array.order), np.int64)
        for shift in (-1, 0):
            have = np.flatnonzero((ahead + shift >= 0) & (ahead + shift < len(query.order)))
            length[have] = np.maximum(length[have], array.common(array.order[have], query, query.order[ahead[have] + shift]))
        some = np.flatnonzero(length)
        places, length = array.order[some], length[some]
        own = self.document(places)
        turn = np.lexsort((places, -length, own))
        first = turn[np.unique(own[turn], return_index=True)[1]]
        own, places, length = own[first], places[first], length[first]
        # Of the block's suffixes that begin with the match, the one of the least item and place, which are in order.
        low, high = query.ranges(array, places, length)
        for d, p, n, a, b in zip(own.tolist(), places.tolist(), length.tolist(), low.tolist(), high.tolist(), strict=True):
            place = p - (int(self.ends[d]) - int(self.lengths[d]) - 1)
            if n > self.best[d][0] or (n == self.best[d][0] and place < self.best[d][1]):
                i = int(query.order[a:b].min())
                item = int(block.item_of(np.array([i]))[0])
                self.best[d] = (n, place, block.items[item], i - int(block.begins[item]))

    def results(self) -> list[tuple]:
        """For each text: hit mask over its words, item ids, and words, place, item and item place of the longest match."""
        return [(self.hit[e - n - 1 : e - 1], sorted(self.items[i]), *self.best[i]) for i, (e, n) in enumerate(zip(self.ends.tolist(), self.lengths.tolist(), strict=True))]


class Benchmark:
    """A block of items as one sequence of word numbers; 0 is an item's end."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW_WORDS):
        vocabulary: dict[bytes, int] = {}
        stream: list[int] = []
        starts: dict[int, list[np.ndarray]] = {}
        self.items: list[str | None] = []
        begins: list[int] = []
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1] or b"")):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            if ids:
                size = min(window, len(ids))
                starts.setdefault(size, []).append(len(stream) + np.arange(len(ids) - size + 1))
                self.items.append(item)
                begins.append(len(stream))
                stream += [*ids, 0]
        self.words = pa.array(list(vocabulary), pa.binary())
        self.tokens, self.begins = np.array(stream, np.int64), np.array(begins, np.int64)
        self.starts = {size: np.concatenate(at) for size, at in sorted(starts.items())}

    def item_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, side="right") - 1

    def search(self, texts: list[bytes | None]) -> list[tuple]:
        """The results of one shard of ``texts``."""
        shard = Shard(texts)
        shard.search(self)
        return shard.results()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int, window: int) -> tuple[Callable[[], Iterator[Benchmark]], int]:
    """A function for tasks that gives the blocks in turn, one from a broadcast, several from files in the work folder; and
    how many shards are worth holding for it."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 if size <= most_bytes else 2 * -(-size // most_bytes)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    # Repeated items add nothing; distinct ones of a block are about ``most_bytes`` at most, a longer item is a block.
    read = lambda kept, part: Benchmark([(r.item, bytes(r.text) if r.text is not None else None) for r in kept.where(F.col("part") == part).distinct().collect()], window)
    if parts == 1:
        one = spark.sparkContext.broadcast(read(rows, 0))
        return lambda: iter([one.value]), 1
    folder, kept = new_folder(spark, "benchmark"), materialise(rows, "benchmark-blocks")
    system, inner = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    for part in range(parts):
        with system.open_output_stream(f"{inner}/{part:06d}") as file:
            file.write(pickle.dumps(read(kept, part)))
    discard(kept)

    def blocks() -> Iterator[Benchmark]:
        system, inner = pyarrow.fs.FileSystem.from_uri(folder)
        for part in range(parts):
            with system.open_input_file(f"{inner}/{part:06d}") as file:
                yield pickle.loads(file.read())

    return blocks, GROUP_SHARDS


def _searched(batches: Iterator[pa.RecordBatch], text_col: str, blocks: Callable[[], Iterator[Benchmark]], shard_bytes: int, group: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Every shard with its results; a group of shards is searched for one block after the other."""
    held: list[tuple[pa.RecordBatch, Shard]] = []

    def searched() -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        for block in blocks() if held else ():
            for _, shard in held:
                shard.search(block)
        yield from ((batch, shard.results()) for batch, shard in held)
        held.clear()

    for whole in batches:
        for batch in slices(whole, text_col, shard_bytes):
            held.append((batch, Shard(batch.column(text_col).cast(pa.binary()).to_pylist())))
            if len(held) >= group:
                yield from searched()
    yield from searched()


#: What ``contamination`` finds in a document.
FOUND = "n_words long, n_hit long, items array<string>, longest_match long, longest_match_at long, longest_item string, longest_item_at long"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW_WORDS, factor: int = HIT_FACTOR, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: words, hit words, items found, the verdict, and the longest verbatim match with its places.

    ``longest_match`` counts words, from word ``longest_match_at`` of the document and ``longest_item_at`` of
    ``longest_item``; it may be shorter than a window, and is 0 (at -1) where no word is shared.
    """
    blocks, group = _blocks(benchmark, item_col, item_text_col, block_bytes, window)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, results in _searched(batches, "text", blocks, shard_bytes, group):
            found = [(len(mask), int(mask.sum()), items, *longest) for mask, items, *longest in results]
            columns = [pa.array([f[i] for f in found], schema.field(i + 1).type) for i in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], schema=schema)

    got = rows.mapInArrow(run, ddl)
    return got.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * factor >= F.col("n_words"))).alias("contaminated"),
        "longest_match",
        "longest_match_at",
        "longest_item",
        "longest_item_at",
        "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW_WORDS, factor: int = HIT_FACTOR, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged."""
    blocks, group = _blocks(benchmark, item_col, item_text_col, block_bytes, window)
    text_name = docs.select(text_col).columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, results in _searched(batches, text_name, blocks, shard_bytes, group):
            hits = [(len(mask), int(mask.sum())) for mask, *_ in results]
            yield batch.filter(pa.array([not (hit and hit * factor >= n) for n, hit in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def brute_force(texts: list[str | None], items: list[tuple[str | None, str | None]], window: int = WINDOW_WORDS) -> list[tuple[int, int, int, str]]:
    """The contract by plain comparison at every position, for tests: n_words, n_hit, n_items, items_sha256."""
    out = []
    split = [(i, words((t or "").encode())) for i, t in items]
    for text in texts:
        have = words((text or "").encode())
        hit, found = [False] * len(have), set()
        for item, own in split:
            size = min(window, len(own))
            for j in range(len(own) - size + 1 if own else 0):
                for p in range(len(have) - size + 1):
                    if have[p : p + size] == own[j : j + size]:
                        hit[p : p + size] = [True] * size
                        found |= {item} - {None}
        out.append((len(have), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def brute_longest(text: str | None, items: list[tuple[str | None, str | None]]) -> int:
    """Words of the longest verbatim match, by plain comparison, for tests."""
    have, longest = words((text or "").encode()), 0
    for _, t in items:
        own = words((t or "").encode())
        for p in range(len(have)):
            for i in range(len(own)):
                n = 0
                while p + n < len(have) and i + n < len(own) and have[p + n] == own[i + n]:
                    n += 1
                longest = max(longest, n)
    return longest
