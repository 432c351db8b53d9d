"""Vector code compression: product quantisation whose codebooks are trained by Lloyd's rounds with heaps.

A vector is cut into equal parts; each part position has its own codebook.  Vectors lie in blocks (stretches of a
partition).  Of every block, part position and codebook entry a heap holds the parts that the entry owns, keyed by lower
bound (distance to the second nearest entry) minus upper bound (distance to its own), plus the entry's drift so far.  An
entry's drift grows each round by how far it moved and how far any other entry of its codebook moved, so a part can only
be nearer to another entry once its key is not above that drift: only such parts are popped and compared with all entries,
exactly; the rest of a heap is not looked at.  Sums and counts of entries change by what the popped parts changed.

Arithmetic is exact.  Components are integers, floor(scale * x).  Squared distances are computed in doubles where the
largest possible value stays below 2**53, else with Python's integers; bounds are widened by more than their rounding.

Each round reads one work table and writes the next; a lost executor repeats a task with the same result.  The driver
holds codebooks, sums and drifts (parts x entries), never a vector but those that the codebooks start from.

Defined cases: vectors that are null or hold null or non-finite components are left out; shorter vectors than the longest
are filled up with zeros, likewise where the parts don't divide the length; with fewer vectors than entries the codebooks
are smaller; equal ids are ordered by their components, null ids come last; repeated rows each get their result; an error
that exceeds a long is null, and so is a sum of errors; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.llm.storage import discard, fresh, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, hence the most parts in its heaps of one position; most components of a block.
BLOCK, BLOCK_COMPONENTS = 8192, 2**20
#: Labels with at least this share of the rows are settled map-side, so as many labels at most are broadcast.
HEAVY_LABELS = 1024
#: Widening of bounds against rounding.
WIDER = 1e-9

#: Doubles above this count as not finite (no single-precision number does).
TOP = 2.0**500
#: Sums travel as digits of so many bits, which Spark adds as longs.
DIGIT = 32


@dataclass
class Codebooks:
    """Entries by part position: integer arrays (part, entry, component)."""

    books: list[np.ndarray]
    scale: int = SCALE

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry, position."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()

    def decode(self, code: list[int]) -> list[float]:
        """The vector that ``code`` stands for: the middle of the entries' cells."""
        return [(int(x) + 0.5) / self.scale for book, e in zip(self.books, code, strict=True) for x in book[e]]


def integers(values: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as int64 where all distances stay exact in doubles, else as Python's integers."""
    top = float(np.abs(values).max(initial=0))
    if 4 * max(1, values.shape[-1]) * (top + 1) ** 2 < 2**53:
        return values.astype(np.int64)
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(x) for x in values.ravel()]
    return out


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all parts (rows) to all entries (columns)."""
    if parts.dtype == object or book.dtype == object:
        p, b = parts.astype(object), book.astype(object)
        return (p * p).sum(1, keepdims=True) - 2 * p.dot(b.T) + (b * b).sum(1) if p.shape[1] else np.zeros((len(p), len(b)), object)
    p, b = parts.astype(np.float64), book.astype(np.float64)
    return (p * p).sum(1, keepdims=True) - 2.0 * (p @ b.T) + (b * b).sum(1)


def root(squares: np.ndarray) -> np.ndarray:
    if squares.dtype == object:
        return np.array([float(math.isqrt(int(x))) for x in squares.ravel()]).reshape(squares.shape)
    return np.sqrt(squares)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower index), and its slack: how much farther the second one is, at least."""
    squares, rows = distances(parts, book), np.arange(len(parts))
    exact = squares.dtype != object
    own = squares.argmin(1) if exact else np.array([min(range(len(r)), key=r.__getitem__) for r in squares], np.int64)
    if len(book) == 1:
        return own, np.full(len(parts), np.inf)
    if not exact:
        squares = root(squares)  # whole roots, so off by less than one
    upper = squares[rows, own]
    squares[rows, own] = np.inf
    lower = squares.min(1)
    upper, lower = (np.sqrt(upper), np.sqrt(lower)) if exact else (upper + 1, lower)
    return own, lower * (1 - WIDER) - upper * (1 + WIDER)


class Heaps:
    """The heaps of one block and part position, one for each entry."""

    def __init__(self, entries: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(entries)]

    def push(self, entry: int, key: float, member: int) -> None:
        heapq.heappush(self.heaps[entry], (key, member))

    def fill(self, owners: np.ndarray, keys: np.ndarray) -> None:
        for member, (entry, key) in enumerate(zip(owners.tolist(), keys.tolist(), strict=True)):
            self.heaps[entry].append((key, member))
        for heap in self.heaps:
            heapq.heapify(heap)

    def pop(self, drift: np.ndarray) -> list[int]:
        """Members whose key their entry's drift has reached."""
        found = []
        for heap, reached in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= reached:
                found.append(heapq.heappop(heap)[1])
        return found

    def pack(self) -> tuple[bytes, bytes]:
        """Keys and members in heap order, heap after heap; ``owners`` tell the lengths."""
        flat = [x for heap in self.heaps for x in heap]
        return np.array([k for k, _ in flat], np.float64).tobytes(), np.array([m for _, m in flat], np.int32).tobytes()

    @classmethod
    def unpack(cls, entries: int, owners: np.ndarray, keys: bytes, members: bytes) -> Heaps:
        out = cls(entries)
        pairs = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(members, np.int32).tolist(), strict=True))
        ends = np.cumsum(np.bincount(owners, minlength=entries))
        out.heaps = [pairs[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]
        return out


def _blocks(scale: int, width: int):
    """Rows (id, label, vector) to blocks of packed integer components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(BLOCK, BLOCK_COMPONENTS // max(1, width)))
        for whole in batches:
            size = -(-whole.num_rows // -(-whole.num_rows // most)) if whole.num_rows else 1
            for begin in range(0, whole.num_rows, size):
                batch = whole.slice(begin, size)
                values = padded(batch.column("vector"), width)
                values = np.floor(values * scale)
                kind = "int16" if np.abs(values).max(initial=0) < 2**15 - 1 else "float64"
                one = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*one, pa.array([values.astype(kind).tobytes()], pa.binary()), pa.array([kind])], ["ids", "labels", "vectors", "kind"])

    return run


def padded(lists: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of a matrix, filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = np.zeros((len(lists), width))
    values[np.repeat(np.arange(len(lists)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
    return values


class Block:
    """The vectors of one row of the work table, with the owner of each part and the heaps of each part position."""

    def __init__(self, row: pa.RecordBatch, books: list[np.ndarray]):
        get = lambda c: row.column(c)[0].as_py()
        self.size = n = len(row.column("ids")[0])
        self.values = np.frombuffer(get("vectors"), get("kind")).reshape(n, len(books), -1).astype(np.float64)
        if "owners" in row.schema.names:
            self.owners = np.frombuffer(get("owners"), np.int32).reshape(len(books), n).copy()
            keys, members = get("heap_keys"), get("heap_members")
            self.heaps = [Heaps.unpack(len(books[0]), self.owners[p], keys[p * n * 8 : (p + 1) * n * 8], members[p * n * 4 : (p + 1) * n * 4]) for p in range(len(books))]
        else:
            self.owners, self.heaps = None, [Heaps(len(books[0])) for _ in books]

    def start(self, books: list[np.ndarray], changed: Changes) -> None:
        """The first round: every part is compared with all entries."""
        self.owners = np.zeros((len(books), self.size), np.int32)
        for p, book in enumerate(books):
            parts = integers(self.values[:, p])
            self.owners[p], slack = nearest(parts, book)
            self.heaps[p].fill(self.owners[p], slack)
            changed.add(p, self.owners[p], parts, 1)

    def advance(self, books: list[np.ndarray], drift: np.ndarray, changed: Changes) -> int:
        """A later round: only parts that the drift has reached are compared; how many were."""
        seen = 0
        for p, book in enumerate(books):
            popped = np.array(self.heaps[p].pop(drift[p]), np.int64)
            seen += len(popped)
            parts, before = integers(self.values[popped, p]), self.owners[p][popped]
            now, slack = nearest(parts, book)
            self.owners[p][popped] = now
            for member, entry, key in zip(popped.tolist(), now.tolist(), (slack + drift[p][now]).tolist(), strict=True):
                self.heaps[p].push(entry, key, member)
            moved = now != before
            changed.add(p, now[moved], parts[moved], 1)
            changed.add(p, before[moved], parts[moved], -1)
        return seen

    def errors(self, books: list[np.ndarray]) -> list[int | None]:
        """Squared distance of each vector to the entries of its parts; null beyond a long."""
        total = np.zeros(self.size, object)
        for p, book in enumerate(books):
            parts = integers(self.values[:, p])
            kind = object if object in (parts.dtype, book.dtype) else np.int64
            off = parts.astype(kind) - book[self.owners[p]].astype(kind)
            total = total + (off * off).sum(1)
        return [int(x) if x < 2**63 else None for x in total]


class Changes:
    """Count and sum of the parts that each entry has won, less those it has lost."""

    def __init__(self, width: int):
        self.width, self.of = width, {}

    def add(self, p: int, entries: np.ndarray, parts: np.ndarray, sign: int) -> None:
        if not len(entries):
            return
        order = np.argsort(entries, kind="stable")
        names, begins = np.unique(entries[order], return_index=True)
        for e, group in zip(names.tolist(), np.split(parts[order], begins[1:]), strict=True):
            have = self.of.setdefault((p, e), [0, [0] * self.width])
            have[0] += sign * len(group)
            have[1] = [a + sign * int(b) for a, b in zip(have[1], group.sum(0), strict=True)]

    def batch(self, schema: pa.Schema, digits: int) -> pa.RecordBatch:
        rows = [(p, e, n, [d for x in total for d in to_digits(x, digits)]) for (p, e), (n, total) in self.of.items()]
        made = {"part": [r[0] for r in rows], "entry": [r[1] for r in rows], "moved": [r[2] for r in rows], "sums": [r[3] for r in rows]}
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


def to_digits(x: int, digits: int) -> list[int]:
    """``x`` in digits of DIGIT bits from the lowest; all are positive but the last, which has the sign."""
    return [(x >> (DIGIT * i)) & (2**DIGIT - 1) for i in range(digits - 1)] + [x >> (DIGIT * (digits - 1))]


def _round(books: list[np.ndarray], drift: np.ndarray, digits: int):
    """One round over blocks; their new state, and what each entry won and lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed, schema = Changes(books[0].shape[1]), None
        for batch in batches:
            schema = _state(batch.schema)
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block(row, books)
                block.start(books, changed) if block.owners is None else block.advance(books, drift, changed)
                keys, members = zip(*(h.pack() for h in block.heaps), strict=True)
                new = {"owners": block.owners.tobytes(), "heap_keys": b"".join(keys), "heap_members": b"".join(members)}
                yield pa.RecordBatch.from_arrays([row.column(f.name) if f.name in HEAD else pa.array([new[f.name]], f.type) if f.name in new else pa.nulls(1, f.type) for f in schema], schema=schema)
        if schema:
            yield changed.batch(schema, digits)

    return run


HEAD = ("ids", "labels", "vectors", "kind")
STATE = "owners binary, heap_keys binary, heap_members binary"


def _state(head: pa.Schema) -> pa.Schema:
    more = {"owners": pa.binary(), "heap_keys": pa.binary(), "heap_members": pa.binary(), "part": pa.int32(), "entry": pa.int32(), "moved": pa.int64(), "sums": pa.list_(pa.int64())}
    return pa.schema([*(head.field(c) for c in HEAD), *(pa.field(*x) for x in more.items())])


def _final(books: list[np.ndarray], drift: np.ndarray):
    """The assignment to the final codebooks: codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed = Changes(books[0].shape[1])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block(row, books)
                block.start(books, changed) if block.owners is None else block.advance(books, drift, changed)
                codes = pa.array([block.owners.T.tolist()], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([row.column("ids"), row.column("labels"), codes, pa.array([block.errors(books)], pa.list_(pa.int64()))], ["ids", "labels", "codes", "errors"])

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """id, label, vector as doubles, without those that the contract leaves out."""
    rows = vectors.select(F.col(id_col).alias("id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where("vector is not null").where(F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= TOP), F.lit(False))))


def _starts(rows: DataFrame, entries: int, parts: int, width: int, scale: int) -> list[np.ndarray]:
    """The codebooks' first entries: the parts of the vectors with the smallest ids."""
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    values = np.zeros((len(first), width))
    for i, r in enumerate(first):
        values[i, : len(r.vector)] = np.floor(np.array(r.vector, np.float64) * scale)
    return [integers(x) for x in np.split(values, parts, axis=1)]


def _updated(books: list[np.ndarray], sums: dict, counts: dict) -> list[np.ndarray]:
    """Every entry that owns parts becomes their componentwise mean, rounded down."""
    out = []
    for p, book in enumerate(books):
        rows = [[s // counts[p, e] for s in sums[p, e]] if counts.get((p, e)) else [int(x) for x in book[e]] for e in range(len(book))]
        top = max((abs(x) for r in rows for x in r), default=0)
        small = 4 * max(1, book.shape[1]) * (top + 1) ** 2 < 2**53
        out.append(np.array(rows, np.int64 if small else object).reshape(book.shape))
    return out


def _moves(old: list[np.ndarray], new: list[np.ndarray]) -> np.ndarray:
    """By part and entry: how far it moved plus how far any other entry of its codebook moved, rounded up."""
    out = np.zeros((len(old), len(old[0])))
    for p, (a, b) in enumerate(zip(old, new, strict=True)):
        off = b.astype(object) - a.astype(object)
        own = np.array([float(math.isqrt(int(x)) + 1) if x else 0.0 for x in (off * off).sum(1)]) if a.shape[1] else np.zeros(len(a))
        order = np.sort(own)
        others = np.where(own == order[-1], order[-2] if len(own) > 1 else 0.0, order[-1])
        out[p] = (own + others) * (1 + WIDER)
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """id, label, ``code`` (entry indexes in part order) and ``error`` (squared distance) of each usable vector; the codebooks."""
    rows = _usable(vectors, id_col, vector_col, label_col, scale)
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    names = [id_col, label_col or "label", "code", "error"]
    shape = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs))), F.count("*")).first()
    width = -(-(shape[0] or 0) // parts) * parts
    # Room for the largest component times all vectors.
    digits = (int(shape[1] or 0) * scale * max(1, shape[2])).bit_length() // DIGIT + 2
    books = _starts(rows, entries, parts, width, scale)
    if not len(books[0]):
        return rows.select("id", "label", F.lit(None).cast("array<int>"), F.lit(None).cast("long")).where("false").toDF(*names), Codebooks(books, scale)
    head = f"ids array<{ids}>, labels array<{labels}>, vectors binary, kind string"
    state = materialise(rows.mapInArrow(_blocks(scale, width), head), "codes-blocks")
    drift, sums, counts = np.zeros((parts, len(books[0]))), {}, {}
    for number in range(rounds):
        after = materialise(state.mapInArrow(_round(books, drift, digits), f"{head}, {STATE}, part int, entry int, moved long, sums array<long>"), f"codes-round{number}")
        discard(state)
        state = after.where("part is null").select(*HEAD, "owners", "heap_keys", "heap_members")
        state.work_folder = after.work_folder
        _gather(after, sums, counts, width // parts, digits)
        new = _updated(books, sums, counts)
        drift, books = drift + _moves(books, new), new
    coded = materialise(state.mapInArrow(_final(books, drift), f"ids array<{ids}>, labels array<{labels}>, codes array<array<int>>, errors array<long>"), "codes-final")
    discard(state)
    coded = coded.select(F.explode(F.arrays_zip("ids", "labels", "codes", "errors")).alias("x")).select("x.ids", "x.labels", "x.codes", "x.errors")
    return coded.toDF(*names), Codebooks(books, scale)


def _gather(after: DataFrame, sums: dict, counts: dict, width: int, digits: int) -> None:
    """Add up what entries won and lost: one row per part position and entry comes back."""
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width * digits)]
    for r in after.where("part is not null").groupBy("part", "entry").agg(F.sum("moved").alias("moved"), *total).collect():
        at = (r.part, r.entry)
        counts[at] = counts.get(at, 0) + r.moved
        won = [sum(r[f"s{i * digits + d}"] << (DIGIT * d) for d in range(digits)) for i in range(width)]
        sums[at] = [a + b for a, b in zip(sums.get(at, [0] * width), won, strict=True)]


def hex_code(code: Column) -> Column:
    """Entry indexes in part order, two lower-case hex digits each."""
    return F.array_join(F.transform(code, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")


def with_label_error(coded: DataFrame, label_col: str = "label", error_col: str = "error") -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over equal labels, nulls together.

    Labels that hold many rows are joined map-side, so no task gathers the rows of one label.
    """
    key, many = fresh(coded.columns, "key"), fresh(coded.columns, "many")
    total = F.when(F.count(error_col) == F.count("*"), F.sum(F.col(error_col).cast("decimal(20,0)"))).try_cast("long")
    sums = materialise(coded.groupBy(F.col(label_col).alias(key)).agg(F.count("*").alias(many), total.alias("label_error")), "codes-labels")
    least = max(2, -(-(sums.agg(F.sum(many)).first()[0] or 0) // HEAVY_LABELS))
    heavy, rest = F.broadcast(sums.where(F.col(many) >= least)), sums.where(F.col(many) < least)
    same = F.col(label_col).eqNullSafe(F.col(key))
    parts = [coded.join(heavy, same), coded.join(heavy, same, "left_anti").join(rest, same)]
    return parts[0].unionByName(parts[1]).drop(key, many)
