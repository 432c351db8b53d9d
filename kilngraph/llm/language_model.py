"""Language-model scores by deleted interpolation of n-gram estimates.

P(w | u v) = L3[b] c(u v w) / c(u v) + L2[b] c(v w) / c(v) + L1[b] c(w) / N + L0[b] / (V + 1): maximum-likelihood estimates
of three orders and a uniform share.  b is the bucket of the context's frequency: the power of two of c(u v), or of c(v)
where u v was never seen.  The weights L of each bucket are learned by expectation-maximisation on held-out counts: every
training document is held out in turn, i.e. its own counts are deleted from all estimates for its tokens.

Layout.  Documents are cut into shards of bounded size; a shard is one row with its tokens as small integers over its own
word list.  Per shard the distinct words, bigrams and trigrams (hashes) with their training counts go, sorted, delta-coded
and compressed, into one row per key range: a single shuffle brings each range together, sums its counts and answers every
shard with the totals in the shard's own key order, so that an answer holds counts alone.  A key that is common everywhere
is one entry per shard.  Shards are then joined with their answers twice: once for the statistics of the EM (a histogram
of bounded size), once to score.  No count table is broadcast or collected; it grows with the corpus and stays in tables.

Words are runs of anything but U+0020 and U+0009-U+000D after lower-casing A-Z; every text ends with one end token.  Words
are 64-bit hashes.  Hashes of bigrams and trigrams have ``KEY_SLACK`` bits more than it takes to number all tokens, so a
key shares its hash with another one with a probability of at most 2^-KEY_SLACK, at any corpus size up to 2^48 tokens.

Defined cases: null and empty texts consist of the end token alone; a null id counts as the id '' for the fold; repeated
rows are separate rows; with no training token every estimate is the uniform one (base_score then uses N = V = 0); an
empty table gives an empty result; further columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kilngraph.llm.storage import materialise

FOLDS, HELD_FOLD = 5, 1
#: Tokens after which a shard is closed, and keys that a range holds on average.
SHARD_TOKENS, RANGE_KEYS = 800_000, 1_500_000
#: Bytes of text per key, at least; only sizes the ranges and hashes.
BYTES_PER_KEY = 6
#: Bits of bigram and trigram hashes beyond those that number all tokens.
KEY_SLACK = 16
#: Buckets of c(v), and after them of c(u v), by powers of two.
CONTEXT_BUCKETS = 24
#: Cells of the EM's histogram: estimates are binned to 1/STEPS octaves over OCTAVES octaves, 0 apart.
STEPS, OCTAVES = 2, 32
EM_ROUNDS, EM_TOLERANCE = 60, 1e-7
_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TRIPLE = np.uint64(0x2545F4914F6CDD1D)


def in_training(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_FOLD


# --- packing -----------------------------------------------------------------------------------------------------


def _deflate(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _inflate(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart so that the mostly empty upper ones vanish in compression."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return _deflate(np.ascontiguousarray(wide.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_inflate(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# --- shards ------------------------------------------------------------------------------------------------------


def bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * _MIX) ^ (right + (left >> np.uint64(23)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shard:
    """Documents as token numbers over a word list; number 0 is the end token, and a document starts after one."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, ends: np.ndarray, train: np.ndarray):
        self.hashes, self.tokens, self.ends, self.train = hashes, tokens, ends, train

    @property
    def doc(self) -> np.ndarray:
        """Document number of each token."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def before(self, back: int) -> np.ndarray:
        """Hash of the word ``back`` places before each token; the start marker before a document's first token."""
        words = self.hashes[self.tokens]
        out = np.concatenate([np.full(min(back, len(words)), _START), words[: max(len(words) - back, 0)]])
        place = np.arange(len(words)) - np.repeat(np.concatenate([[0], self.ends[:-1]]), np.diff(self.ends, prepend=0))
        out[place < back] = _START
        return out

    def keys(self, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By kind: its distinct keys, sorted, and each token's place in them; keys of longer n-grams have ``bits`` bits."""
        words, one, two = self.hashes[self.tokens], self.before(1), self.before(2)
        pairs = bigram_keys(one, words)
        drop = np.uint64(64 - bits)
        out = {UNIGRAM: words, BIGRAM: pairs >> drop, TRIGRAM: bigram_keys(two ^ _TRIPLE, pairs) >> drop}
        return {kind: (lambda u: (u[0], u[1].reshape(-1)))(np.unique(keys, return_inverse=True)) for kind, keys in out.items()}

    def dump(self) -> dict[str, bytes]:
        return {"hashes": self.hashes.tobytes(), "tokens": pack(self.tokens), "ends": pack(self.ends), "train": np.packbits(self.train).tobytes()}

    @staticmethod
    def load(row: dict) -> Shard:
        ends = unpack(row["ends"]).astype(np.int64)
        train = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(ends)).astype(bool)
        return Shard(np.frombuffer(row["hashes"], np.uint64), unpack(row["tokens"]).astype(np.int64), ends, train)


SHARD_COLUMNS = ("hashes", "tokens", "ends", "train")
SHARD_DDL = "shard long, ids binary, hashes binary, tokens binary, ends binary, train binary"
REQUEST_DDL = "shard long, kind int, span int, keys binary, counts binary"
#: Kinds of requests.
UNIGRAM, BIGRAM, TRIGRAM = 1, 2, 3


def _spans(keys: np.ndarray, spans: int, bits: int = 64) -> np.ndarray:
    """Where each of ``spans`` equal ranges of ``bits``-bit keys begins in sorted keys, and the end."""
    edges = (np.arange(1, spans, dtype=object) * (1 << bits) // spans).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _serialise_ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    return _deflate(sink.getvalue().to_pybytes())


def _ids(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(_inflate(data)).read_all().column(0).combine_chunks()


def _requests(spans: int, bits: int):
    """A shard's distinct words, bigrams and trigrams with their training counts, one row per key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("span", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.load(row)
                learns = shard.train[shard.doc]
                for kind, (keys, at) in shard.keys(bits).items():
                    counts, edges, rows = np.bincount(at[learns], minlength=len(keys)), _spans(keys, spans, 64 if kind == UNIGRAM else bits), []
                    for s, (b, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        if e > b:
                            rows.append({"shard": row["shard"], "kind": kind, "span": s, "keys": pack_sorted(keys[b:e]), "counts": pack(counts[b:e])})
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _cut(shard_tokens: int):
    """Cuts a task's documents into shards, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("ids", *SHARD_COLUMNS)]])
        vocabulary: dict[bytes, int] = {}
        hashes: list[int] = [int(_END)]
        tokens: list[np.ndarray] = []
        ends: list[int] = []
        train: list[bool] = []
        ids: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            shard = Shard(np.array(hashes, np.uint64), np.concatenate(tokens), np.array(ends, np.int64), np.array(train, bool))
            rows = [{"shard": number, "ids": _serialise_ids(pa.concat_arrays(ids))} | shard.dump()]
            number, size = number + 1, 0
            for part in (vocabulary, tokens, ends, train, ids):
                part.clear()
            del hashes[1:]
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            begin = 0
            learns = batch.column("train").to_pylist()
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = text.lower().split() if text else []
                own = np.zeros(len(words) + 1, np.int32)
                for p, w in enumerate(words):
                    n = vocabulary.get(w)
                    if n is None:
                        n = vocabulary[w] = len(hashes)
                        hashes.append(xxhash.xxh3_64_intdigest(w))
                    own[p] = n
                tokens.append(own)
                size += len(own)
                ends.append(size)
                train.append(learns[i])
                if size >= shard_tokens:
                    ids.append(batch.column("id").slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield close()
            if begin < batch.num_rows:
                ids.append(batch.column("id").slice(begin))
        if size:
            yield close()

    return run


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums one key range over all shards and answers each with its totals; also the range's own totals."""
    shards, keys, counts = rows.column("shard").to_pylist(), [], []
    for k, c in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        keys.append(unpack_sorted(k))
        counts.append(unpack(c))
    lengths = np.cumsum([0, *map(len, keys)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at.reshape(-1), np.concatenate(counts).astype(np.float64), len(distinct)).astype(np.uint64)
    mine = [pack(total[at[b:e]]) for b, e in zip(lengths[:-1], lengths[1:], strict=True)]
    kind, span = key[0].as_py(), key[1].as_py()
    n = len(shards)
    return pa.table({"shard": pa.array(shards, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "span": pa.array([span] * n, pa.int32()), "totals": pa.array(mine, pa.binary()), "tokens": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), "types": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64())})


ANSWER_DDL = "shard long, kind int, span int, totals binary, tokens long, types long"


class Tokens:
    """Every token of a shard with its total counts and its own document's training counts."""

    def __init__(self, shard: Shard, answers: pa.Table, starts: int, bits: int):
        self.shard, self.starts = shard, starts
        self.at: dict[int, np.ndarray] = {}
        self.size: dict[int, int] = {}
        self.total: dict[int, np.ndarray] = {}
        order = np.argsort(answers.column("span").to_numpy(), kind="stable")
        kinds = answers.column("kind").to_numpy()
        for kind, (keys, at) in shard.keys(bits).items():
            parts = [unpack(answers.column("totals")[int(i)].as_py()) for i in order if kinds[i] == kind]
            self.at[kind], self.size[kind] = at, len(keys)
            self.total[kind] = np.concatenate(parts)[at].astype(np.float64)

    def after(self, per_token: np.ndarray, first: float) -> np.ndarray:
        """What ``per_token`` says of the token before each one; ``first`` at a document's first token."""
        out = np.concatenate([[first], per_token[:-1]])
        out[self.shard.ends[:-1]] = first
        return out

    def counts(self) -> tuple[np.ndarray, ...]:
        """c(w), c(v w), c(u v w), c(v) and c(u v) of each token."""
        word, pair, triple = (self.total[k] for k in (UNIGRAM, BIGRAM, TRIGRAM))
        return word, pair, triple, self.after(word, float(self.starts)), self.after(pair, float(self.starts))

    def own_counts(self) -> tuple[np.ndarray, ...]:
        """The same within each token's own document."""
        doc = self.shard.doc.astype(np.int64)

        def count(kind: int) -> np.ndarray:
            _, where, found = np.unique(doc * self.size[kind] + self.at[kind], return_inverse=True, return_counts=True)
            return found[where.reshape(-1)].astype(np.float64)

        word, pair, triple = (count(k) for k in (UNIGRAM, BIGRAM, TRIGRAM))
        return word, pair, triple, self.after(word, 1.0), self.after(pair, 1.0)


def estimates(counts: tuple[np.ndarray, ...], n: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates (trigram, bigram, unigram; one row per token) and the bucket of the context."""
    word, pair, triple, before, before2 = counts
    ratio = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y > 0)
    power = lambda x: np.minimum(np.floor(np.log2(np.maximum(x, 0) + 1)).astype(np.int64), CONTEXT_BUCKETS - 1)
    bucket = np.where(before2 > 0, CONTEXT_BUCKETS + power(before2), power(before))
    total = np.broadcast_to(np.asarray(n, dtype=np.float64), word.shape)
    return np.stack([ratio(triple, before2), ratio(pair, before), ratio(word, total)], 1), bucket


def _level(p: np.ndarray) -> np.ndarray:
    """Histogram level of a probability; 0 stands for 0."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = np.clip(np.rint(-np.log2(p[some]) * STEPS), 0, STEPS * OCTAVES - 1).astype(np.int64) + 1
    return out


LEVELS = STEPS * OCTAVES + 1


def held_out_cells(seen: Tokens, n: int) -> np.ndarray:
    """Histogram cell (bucket, levels of the three estimates) of every training token, its own document deleted."""
    learns = seen.shard.train[seen.shard.doc]
    counts = tuple((total - own)[learns] for total, own in zip(seen.counts(), seen.own_counts(), strict=True))
    length = np.diff(seen.shard.ends, prepend=0)[seen.shard.doc].astype(np.float64)
    parts, bucket = estimates(counts, float(n) - length[learns])
    cell = bucket
    for k in range(parts.shape[1]):
        cell = cell * LEVELS + _level(parts[:, k])
    return cell


def _statistics(n: int, starts: int, bits: int):
    """Histogram over held-out training tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = [held_out_cells(Tokens(Shard.load(row), right, starts, bits), n) for row in left.to_pylist()]
        cell, many = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"cell": pa.array(cell, pa.int64()), "many": pa.array(many, pa.int64())})

    return run


def learn_weights(cell: np.ndarray, many: np.ndarray, v: int) -> np.ndarray:
    """EM for the weights (trigram, bigram, unigram, uniform) of each bucket; a bucket without data leans on unigrams."""
    weights = np.tile([0.05, 0.1, 0.8, 0.05], (2 * CONTEXT_BUCKETS, 1))
    value = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / STEPS), 0.0)
    bucket = cell // LEVELS**3
    parts = np.stack([value(cell // LEVELS**2 % LEVELS), value(cell // LEVELS % LEVELS), value(cell % LEVELS), np.full(len(cell), 1.0 / (v + 1))], 1)
    for b in range(2 * CONTEXT_BUCKETS):
        mine = bucket == b
        if not mine.any():
            continue
        p, m, w = parts[mine], many[mine].astype(float), np.full(4, 0.25)
        for _ in range(EM_ROUNDS):
            share = p * w
            share /= share.sum(1, keepdims=True)
            # A thousandth of a token each keeps every weight above zero.
            new = (share * m[:, None]).sum(0) + 1e-3
            new /= new.sum()
            done = np.abs(new - w).max() < EM_TOLERANCE
            w = new
            if done:
                break
        weights[b] = w
    return weights


def _score(n: int, v: int, starts: int, bits: int, weights: np.ndarray, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            seen = Tokens(Shard.load(row), right, starts, bits)
            counts = seen.counts()
            parts, bucket = estimates(counts, float(n))
            p = np.log10((weights[bucket, :3] * parts).sum(1) + weights[bucket, 3] / (v + 1))
            base = np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))
            begin = np.concatenate([[0], seen.shard.ends[:-1]])
            add = lambda x: np.add.reduceat(x, begin)
            columns = [_ids(row["ids"]), pa.array(~seen.shard.train), pa.array(np.diff(seen.shard.ends, prepend=0)), pa.array(add((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(begin), n)), pa.array(add(base)), pa.array(add(p))]
            out.append(pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shard_tokens: int = SHARD_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), in_training(id_col).alias("train"))
    size, starts = rows.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    spans = max(16, math.ceil((size or 0) / (BYTES_PER_KEY * range_keys)))
    bits = min(64, math.ceil(math.log2(max(2, (size or 0) / BYTES_PER_KEY))) + KEY_SLACK)
    shards = materialise(rows.mapInArrow(_cut(shard_tokens), SHARD_DDL), "lm-shards")
    requests = shards.select("shard", *SHARD_COLUMNS).mapInArrow(_requests(spans, bits), REQUEST_DDL)
    answers = materialise(requests.repartition(3 * spans, "kind", "span").groupBy("kind", "span").applyInArrow(_answer, ANSWER_DDL), "lm-answers")
    found = answers.where(F.col("kind") == UNIGRAM).agg(F.sum("tokens"), F.sum("types")).first()
    n, v = (int(x or 0) for x in found)
    both = lambda: shards.groupBy("shard").cogroup(answers.select("shard", "kind", "span", "totals").groupBy("shard"))
    cells = both().applyInArrow(_statistics(n, starts, bits), "cell long, many long").groupBy("cell").agg(F.sum("many").alias("many"))
    # Bounded: 2 * CONTEXT_BUCKETS * LEVELS^3 cells, some thirteen million, at the very most.
    got = materialise(cells, "lm-cells").toPandas()
    order = np.argsort(got.cell.to_numpy())
    weights = learn_weights(got.cell.to_numpy()[order], got.many.to_numpy()[order], v)
    kind = rows.schema["id"].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    return both().applyInArrow(_score(n, v, starts, bits, weights, schema), ddl)
