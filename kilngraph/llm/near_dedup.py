"""MinHash near-deduplication with SetSketch registers.

A document's distinct word shingles are sketched into M registers.  Register i holds how far the smallest of the set's
exponential variates lies down a geometric scale (base ``BASE``), truncated to a byte.  Registers of a union are the
maxima of the registers, so sketches merge; two sets agree in a register with a probability close to their Jaccard
similarity, so bands of registers serve as bucket keys.

1. One pass over the documents: set size, a 128-bit digest of the set, registers.  Documents with equal sets form one
   class; from here on each class counts once, however many copies it has.
2. Every class goes to one bucket per band.  Buckets of one class are left at once.
3. Star rounds: in each bucket whose classes are in different components, each class is paired with one hub.  The first
   round takes the most central class, the one whose buckets are fullest over all bands: copies with edits of their own
   resemble their common origin more than each other.  The next takes hubs in pseudo-random order.  Sizes prune a pair
   first; then its similarity is estimated jointly, by maximum likelihood over the counts of greater, smaller and equal
   registers given both set sizes; pairs whose likelihood at the threshold is hopeless are dropped, all others are
   verified on the full shingle sets.  Verified links join components.
4. The classes of the buckets that still hold several components are searched exactly, with no bound on a bucket: a
   prefix join of their full sets.  Shingles are ordered by rarity among these classes.  Of a linked pair, the smaller
   set holds a common shingle among its n - ceil(2t/(1+t) n) + 1 rarest, the larger among its n - ceil(t n) + 1 rarest
   (t the threshold), so postings of these prefixes meet; what a crowd of texts has in common is frequent, hence behind
   the prefixes.  Pairs pass the size and positional filters, then estimate and verification as above.  Under a shingle,
   classes of its largest component meet only classes outside it, and frequent shingles are dealt over several tasks.

Bands of 8 out of 512 registers miss a link of similarity 0.8 with probability 3e-6.

Words are runs of anything but U+0020 and U+0009-U+000D, with A-Z lower-cased; shingles are 64-bit hashes of the words.

Defined cases: a null, empty or wordless text has no shingles, is linked with nothing and stays; a text with fewer words
than a shingle is one shingle; a null id ranks behind every other id for the name of a component; rows that repeat are in
one component; an empty table gives an empty result; further columns are kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm.components import components
from kilngraph.llm.removal import BROADCAST_ROWS, without
from kilngraph.llm.storage import discard, materialise, slices

SHINGLE_WORDS = 5
#: Link when HUNDREDTHS * union <= 100 * intersection.
HUNDREDTHS = 80
REGISTERS, BAND = 512, 8
BASE, OFFSET = 1.1, 25
#: A pair is dropped unverified if its likelihood at the threshold is below its best by so many nats.
HOPELESS = 20.0
STAR_ROUNDS = 2
#: Postings of one shingle that one task compares with all others.
PREFIX_ROWS = 1024
SEED = 0x5E75CE7C
CHUNK = 1 << 15
#: Cached word hashes of a task.
CACHE_WORDS = 100_000

_rng = np.random.default_rng(SEED)
MULTIPLIERS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
BAND_SALT = _rng.integers(0, 1 << 63, REGISTERS // BAND, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, computed once per word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, k: int, cache: WordHashes) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out * _STEP + h[i : i + n])
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row of bytes per non-empty set."""
    out = np.empty((len(sets), REGISTERS), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        scratch = np.empty_like(x)
        for i, a in enumerate(MULTIPLIERS):
            np.multiply(x, a, out=scratch)
            out[begin:end, i] = np.minimum.reduceat(scratch, starts)
        begin = end
    # The smallest uniform gives the smallest exponential variate; the register is its floored place on the scale.
    rate = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(OFFSET - np.log(rate) / math.log(BASE)), 0, 255).astype(np.uint8)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, of shape (sets, bands)."""
    return _mix(_mix(np.ascontiguousarray(regs).view(np.uint64) ^ BAND_SALT) + BAND_SALT)


def log_likelihood(j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity ``j`` given set sizes and how many registers of a are above, below or equal."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))


def worth_verifying(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that may reach the threshold: the best similarity is at or above it, or not surely below."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.linspace(0, 1, 101)
    fits = np.stack([log_likelihood(np.minimum(g, most), n_a, n_b, more, less, same) for g in grid])
    best = np.minimum(grid[fits.argmax(0)], most)
    at = log_likelihood(np.full(len(a), threshold), n_a, n_b, more, less, same)
    return (most >= threshold - 1e-12) & ((best >= threshold) | (fits.max(0) - at < HOPELESS))


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingle_set(t, k, cache) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                digests: list[bytes | None] = [None] * len(sets)
                regs: list[bytes | None] = [None] * len(sets)
                for i, r in zip(some.tolist(), registers([sets[i] for i in some]) if len(some) else [], strict=True):
                    digests[i], regs[i] = set_digest(sets[i]), r.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["id", "mark", "n", "digest", "regs"])

    return run


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "regs"):
            keys = band_keys(_registers_of(batch.column("regs")))
            nodes, sizes = (np.repeat(np.asarray(batch.column(c)), keys.shape[1]) for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes), pa.array(sizes)], ["key", "node", "n"])


def _estimate(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "regs_a", 500_000):
                a, b = (_registers_of(batch.column(c)) for c in ("regs_a", "regs_b"))
                keep = worth_verifying(a, b, np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")), threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _sets(k: int):
    """Full shingle sets of the wanted classes; a row whose text has another digest (a repeated id) is not the wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingle_set(t, k, cache) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                keep = [i for i, d in enumerate(batch.column("digest").to_pylist()) if len(found[i]) and set_digest(found[i]) == d]
                ends = np.cumsum([0, *(len(found[i]) for i in keep)])
                values = np.concatenate([found[i] for i in keep]).view(np.int64) if keep else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["node", "shingles"])

    return run


def _verify(hundredths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), (y, to) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("set_a"), batch.column("set_b")))
            keep = []
            for i in range(batch.num_rows):
                p, q = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= hundredths * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Linker:
    """Estimates and verifies candidate pairs of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, hundredths: int):
        self.docs, self.classes, self.k, self.hundredths = docs, classes, k, hundredths

    def links(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that are links, as a written table; ``sets`` may hold the full sets already."""
        side = lambda c: self.classes.select(F.col("node").alias(f"node_{c}"), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
        rows = pairs
        for c in ("a", "b"):
            rows = rows.join(side(c), F.col(c) == F.col(f"node_{c}")).drop(f"node_{c}")
        rows = hopeful = materialise(rows.mapInArrow(_estimate(self.hundredths / 100), "a long, b long"), "near-hopeful")
        own = sets is None
        if sets is None:
            sets = self.full_sets(hopeful.select(F.col("a").alias("node")).unionByName(hopeful.select(F.col("b").alias("node"))).distinct())
        for c in ("a", "b"):
            rows = rows.join(sets.select(F.col("node").alias(f"node_{c}"), F.col("shingles").alias(f"set_{c}")), F.col(c) == F.col(f"node_{c}")).drop(f"node_{c}")
        found = materialise(rows.mapInArrow(_verify(self.hundredths), "a long, b long"), "near-links")
        discard(hopeful, sets if own else None)
        return found

    def full_sets(self, nodes: DataFrame) -> DataFrame:
        """node, shingles (sorted 64-bit hashes) of the classes in ``nodes``, as a written table."""
        wanted = self.classes.join(nodes.select(F.col("node").alias("want")), F.col("node") == F.col("want")).select("node", "digest", F.col("mark").alias("class_mark"), F.col("id").alias("class_id"))
        wanted = materialise(wanted, "near-wanted")
        marked = wanted.count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(wanted) if marked else wanted, (F.col("mark") == F.col("class_mark")) & F.col("id").eqNullSafe(F.col("class_id")))
        texts = texts.select("node", "digest", "text").mapInArrow(_sets(self.k), "node long, shingles array<long>")
        found = materialise(texts.dropDuplicates(["node"]), "near-sets")
        discard(wanted)
        return found

    def prefix_pairs(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components among ``nodes`` (node, n, comp) that the prefix join cannot rule out."""
        h = self.hundredths
        tokens = sets.select("node", F.explode("shingles").alias("token"))
        counts = tokens.groupBy("token").agg(F.count("*").alias("many"))
        ordered = tokens.join(counts.withColumnRenamed("token", "of"), F.col("token") == F.col("of")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("all"))
        n, up = F.size("all"), lambda x: F.ceil(x).cast("int")
        probe, index = n - up(n * h / F.lit(100)) + 1, n - up(n * (2 * h) / F.lit(100 + h)) + 1
        postings = ordered.select("node", index.alias("index"), F.posexplode(F.slice("all", F.lit(1), probe)).alias("pos", "one"))
        postings = postings.where("one.many > 1").select("node", (F.col("pos") < F.col("index")).alias("small"), "pos", F.col("one.token").alias("token"))
        postings = materialise(postings.join(nodes.select(F.col("node").alias("of"), "n", "comp"), F.col("node") == F.col("of")).drop("of"), "near-postings")
        # Per shingle: its largest component, and how many postings its smaller sides have.
        parts = postings.groupBy("token", "comp").agg(F.count("*").alias("part"), F.count_if("small").alias("smalls"))
        parts = parts.groupBy("token").agg(F.max(F.struct("part", "comp")).alias("top"), F.sum("smalls").alias("smalls"), F.count("*").alias("comps")).where("comps > 1 and smalls > 0")
        parts = parts.select(F.col("token").alias("of"), F.col("top.comp").alias("main"), F.ceil(F.col("smalls") / F.lit(PREFIX_ROWS)).cast("int").alias("tasks"))
        rows = postings.join(parts, F.col("token") == F.col("of")).withColumn("inside", F.col("comp") == F.col("main"))
        y = rows.where("small").select(F.col("token").alias("y_token"), F.col("inside").alias("y_inside"), F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("tasks")).cast("int").alias("y_task"), *[F.col(c).alias(f"y_{c}") for c in ("node", "pos", "n", "comp")])
        # The larger side stands under "smaller side outside the main component", and again under "inside" if it is outside itself.
        x = rows.withColumn("under", F.explode(F.when(F.col("inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        x = x.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select("token", "under", "task", "node", "pos", "n", "comp")
        fits = (F.col("comp") != F.col("y_comp")) & (F.struct("n", "node") > F.struct("y_n", "y_node")) & (100 * F.col("y_n") >= h * F.col("n"))
        overlap = 1 + F.least(F.col("n") - 1 - F.col("pos"), F.col("y_n") - 1 - F.col("y_pos"))
        fits = fits & ((100 + h) * overlap >= h * (F.col("n") + F.col("y_n")))
        pairs = x.join(y, (F.col("token") == F.col("y_token")) & (F.col("under") == F.col("y_inside")) & (F.col("task") == F.col("y_task")) & fits)
        found = materialise(pairs.select(F.least("node", "y_node").alias("a"), F.greatest("node", "y_node").alias("b")).distinct(), "near-pairs")
        discard(postings)
        return found


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, comp) after joining the components at both ends of each link."""
    mine = lambda c: labels.select(F.col("node").alias(f"node_{c}"), F.col("comp").alias(f"comp_{c}"))
    ends = links
    for c in ("a", "b"):
        ends = ends.join(mine(c), F.col(c) == F.col(f"node_{c}"))
    merged = components(ends, "comp_a", "comp_b").select(F.col("node").alias("old"), "label")
    found = materialise(labels.join(merged, F.col("comp") == F.col("old"), "left").select("node", "central", F.coalesce("label", "comp").alias("comp")), "near-labels")
    discard(labels)
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, hundredths: int) -> tuple[DataFrame, DataFrame]:
    """(rows, components): one row per document with its class digest; and digest -> component, component_id."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64(F.lit(SEED), "text"))
    kind = named.schema["id"].dataType.simpleString()
    rows = materialise(named.select("id", "mark", "text").mapInArrow(_sketch(k), f"id {kind}, mark long, n long, digest binary, regs binary"), "near-sketches")
    filled = rows.where("n > 0")
    best = filled.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "mark")).alias("top"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = materialise(best.select("digest", "n", "regs", "top.id", "top.mark").withColumn("node", F.monotonically_increasing_id()), "near-classes")
    linker = _Linker(named, classes, k, hundredths)

    buckets = classes.select("node", "n", "regs").mapInArrow(_buckets, "key long, node long, n long")
    shared = buckets.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1").select(F.col("key").alias("shared_key"), "crowd")
    buckets = materialise(buckets.join(shared, F.col("key") == F.col("shared_key")).select("key", "node", "n", "crowd"), "near-buckets")
    labels = materialise(buckets.groupBy("node").agg(F.sum("crowd").alias("central"), F.first("node").alias("comp")), "near-labels")

    def still_open() -> DataFrame:
        """key, node, n, central, comp for the buckets that hold several components."""
        rows = buckets.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of", "crowd")
        split = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(F.col("key").alias("open_key"))
        return materialise(rows.join(split, F.col("key") == F.col("open_key")).drop("open_key"), "near-open")

    near_size = lambda x, y: 100 * F.least(x, y) >= hundredths * F.greatest(x, y)
    tried: DataFrame | None = None
    spent: list[DataFrame] = [classes]
    for turn in range(STAR_ROUNDS):
        open_ = still_open()
        weight = F.col("central") if turn == 0 else F.xxhash64(F.lit(SEED + turn), "node")
        hubs = open_.groupBy("key").agg(F.max(F.struct(weight.alias("weight"), "node", "n", "comp")).alias("h"))
        hubs = hubs.select(F.col("key").alias("hub_key"), F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.comp").alias("hub_comp"))
        pairs = open_.join(hubs, F.col("key") == F.col("hub_key")).where((F.col("comp") != F.col("hub_comp")) & near_size(F.col("n"), F.col("hub_n")))
        pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        spent.append(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = linker.links(pairs)
        labels = _merged(labels, links)
        discard(open_, links)
    open_ = still_open()
    nodes = materialise(open_.select("node", "n", "comp").distinct(), "near-nodes")
    discard(open_, buckets)
    sets = linker.full_sets(nodes)
    pairs = linker.prefix_pairs(nodes, sets)
    links = linker.links(pairs.join(tried, ["a", "b"], "left_anti"), sets)
    labels = _merged(labels, links)
    discard(nodes, sets, pairs, links)
    named_classes = classes.select("node", "digest", "id").join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("comp", F.coalesce("comp", "node"))
    named_classes = materialise(named_classes.select("digest", "id", "comp"), "near-named")
    names = materialise(named_classes.groupBy(F.col("comp").alias("named")).agg(F.min("id").alias("component_id")), "near-names")
    found = named_classes.join(names, F.col("comp") == F.col("named")).select(F.col("digest").alias("class_digest"), "comp", "component_id")
    found = materialise(found, "near-components")
    discard(named_classes, names, labels, *spent)
    narrow = rows.drop("regs")
    narrow.work_folder = rows.work_folder
    return narrow, found


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = SHINGLE_WORDS, hundredths: int = HUNDREDTHS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    rows, found = _classes(docs, id_col, text_col, shingle_words, hundredths)
    rows = rows.join(found, F.col("digest") == F.col("class_digest"), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = SHINGLE_WORDS, hundredths: int = HUNDREDTHS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component the row with its smallest id.

    Of rows that share that id and are in the component, the one with the smallest text hash stays; rows without words
    all stay.
    """
    rows, found = _classes(docs, id_col, text_col, shingle_words, hundredths)
    member = rows.where("n > 0").join(found, F.col("digest") == F.col("class_digest")).groupBy("comp", "id", "mark").agg(F.count("*").alias("many"))
    member = materialise(member, "near-members")
    top = member.groupBy(F.col("comp").alias("of")).agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "mark")).alias("top"))
    judged = member.join(top, F.col("comp") == F.col("of")).withColumn("stays", F.col("id").eqNullSafe(F.col("top.id")) & (F.col("mark") == F.col("top.mark")))
    judged = materialise(judged.where("not stays or many > 1").select("id", "mark", "stays"), "near-dropped")
    discard(rows, found, member)
    return without(docs, judged, id_col, F.xxhash64(F.lit(SEED), F.col(text_col)))
