"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

One pass over the texts finds the pattern matches, counts character trigrams and lists long runs of key characters that
no pattern covers.  The model of random strings learns from what the patterns matched (the labelled secrets of the
corpus) and from seeded random strings over common alphabets; the model of ordinary identifiers learns from every run of
key characters in every text that is too short to be listed, as the listed ones have no label yet.  Both are interpolated
trigram models.  A run is a secret if some stretch of it is so much likelier under the first model that the odds, started
from ``prior_odds``, come out above one.  The second pass reads the listed runs only, no text.

Memory: a task holds a slice of texts and one trigram table (69 characters and the border, cubed); the driver holds two
such tables, whatever the size of the corpus.

Defined cases: a null text counts as empty and has no span; a null id is carried; repeated rows each get their result;
an empty table gives an empty result; further columns are ignored, whatever their names; texts are read whole.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.llm.storage import materialise, slices

#: Kinds in the order of their listing.
KINDS = ("assign", "access", "hex", "model")
#: The patterns and the length that a match, or the group named, has to have.
PATTERNS = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 1, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: What a text with a long enough match contains; only such texts are unpacked.
SIEVES = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
#: Characters of keys; a run of them is a candidate from this length on.
KEY_CHARS, LEAST_RUN = string.ascii_letters + string.digits + "+/_-=.", 16
RUN, RUN_SIEVE = r"[A-Za-z0-9+/_-]{%d,}={0,2}", r"[A-Za-z0-9+/_-]{%d}"
#: Odds, before a run is read, that it is a secret.
PRIOR_ODDS = 1e-6
#: Shares of trigrams, bigrams, characters and the even distribution in both models.
MIXTURE = (0.6, 0.25, 0.1, 0.05)
#: Seeded random strings for the first model: their alphabets, how many of each, and their length.
ALPHABETS = (string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
RANDOM_STRINGS, RANDOM_LENGTH, SEED = 400, 40, 13

SIZE = len(KEY_CHARS) + 1
_CODES = np.zeros(256, np.int32)
_CODES[np.frombuffer(KEY_CHARS.encode(), np.uint8)] = np.arange(1, SIZE)

FOUND = "spans array<struct<kind:string,start:int,end:int>>, runs array<struct<start:int,end:int,text:string>>, random boolean, code array<int>, n array<long>"


def base_spans(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[str, int, int, str]]:
    """kind, start, end, key of each pattern match that is long enough: leftmost, without overlap within a kind."""
    found = []
    for kind in kinds:
        pattern, group, least = PATTERNS[kind]
        found += [(kind, *m.span(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def open_runs(text: str, spans: list[tuple], least: int = LEAST_RUN) -> list[tuple[int, int, str]]:
    """start, end, text of the runs of key characters that touch none of ``spans`` (sorted by start)."""
    runs, at, reach = [], 0, -1
    for m in re.finditer(RUN % least, text):
        while at < len(spans) and spans[at][1] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            runs.append((m.start(), m.end(), m[0]))
    return runs


def trigrams(data: np.ndarray, step: int = 1_000_000) -> np.ndarray:
    """Counts of character trigrams of bytes; other characters than those of keys are borders, which nothing spans."""
    counts, before = np.zeros(SIZE**3, np.int64), np.zeros(2, np.int32)
    for begin in range(0, len(data) + 1, step):
        part = _CODES[data[begin : begin + step]]
        codes = np.concatenate((before, part, np.zeros(int(begin + step > len(data)), np.int32)))
        first, second, third = codes[:-2], codes[1:-1], codes[2:]
        first = np.where(second == 0, 0, first)
        # A border after a border says nothing.
        counts += np.bincount(((first * SIZE + second) * SIZE + third)[(second != 0) | (third != 0)], minlength=SIZE**3)
        before = codes[-2:]
    return counts


def _packed(values: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(values).encode(), np.uint8)


def _scan(least: int):
    sieves = {**SIEVES, "run": RUN_SIEVE % least}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, labelled = np.zeros(SIZE**3, np.int64), np.zeros(SIZE**3, np.int64)
        schema = None
        for batch in batches:
            schema = _schema(batch.column("id").type)
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("")
                hit = {kind: pc.match_substring_regex(texts, sieve).to_numpy(zero_copy_only=False) for kind, sieve in sieves.items()}
                many = len(texts)
                spans, runs, keys, rest = [[] for _ in range(many)], [[] for _ in range(many)], [], []
                for i in np.flatnonzero(np.logical_or.reduce(list(hit.values()))):
                    text = texts[int(i)].as_py()
                    found = base_spans(text, tuple(k for k in KINDS[:3] if hit[k][i]))
                    keys += {f[3] for f in found}  # a key that two patterns match is one key
                    spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b, _ in found]
                    open_ = open_runs(text, found, least)
                    runs[i] = [{"start": a, "end": b, "text": t} for a, b, t in open_]
                    rest.append(_without(text, sorted([f[1:3] for f in found] + [o[:2] for o in open_])))
                plain = texts.filter(pa.array(~np.logical_or.reduce(list(hit.values()))))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")
                ordinary += trigrams(np.frombuffer(joined[0].as_buffer(), np.uint8)) + trigrams(_packed(rest))
                labelled += trigrams(_packed(keys))
                yield _batch(schema, part.column("id"), spans=spans, runs=runs)
        if schema:
            for label, counts in ((False, ordinary), (True, labelled)):
                code = np.flatnonzero(counts)
                yield _batch(schema, pa.nulls(1, schema.field("id").type), random=[label], code=[code], n=[counts[code]])

    return run


def _batch(schema: pa.Schema, ids: pa.Array, **columns: list) -> pa.RecordBatch:
    values = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(ids), f.type) for f in schema if f.name != "id"]
    return pa.RecordBatch.from_arrays([ids, *values], schema=schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with a blank for each stretch that ``spans`` (sorted) cover."""
    parts, at = [], 0
    for start, end in spans:
        if end > at:
            parts.append(text[at:start] if start > at else "")
            at = end
    return " ".join([*parts, text[at:]])


def _schema(id_type: pa.DataType) -> pa.Schema:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    run = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
    return pa.schema([("id", id_type), ("spans", pa.list_(span)), ("runs", pa.list_(run)), ("random", pa.bool_()), ("code", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def random_strings(seed: int = SEED) -> list[str]:
    """Labelled random strings over common alphabets."""
    draw = random.Random(seed)
    return ["".join(draw.choices(alphabet, k=RANDOM_LENGTH)) for alphabet in ALPHABETS for _ in range(RANDOM_STRINGS)]


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a character after two others: a fixed mixture of trigrams, bigrams, characters, and all alike.

    Fixed shares keep a trigram that no word has yet close to its bigram, however many words were counted.
    """
    three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    two, one = three.sum(0), three.sum((0, 1))
    even = np.full(SIZE, 1 / SIZE)
    one = one / one.sum() if one.sum() else even
    two = np.where(two.sum(1, keepdims=True) > 0, two / np.maximum(two.sum(1, keepdims=True), 1), one)
    three = np.where(three.sum(2, keepdims=True) > 0, three / np.maximum(three.sum(2, keepdims=True), 1), two)
    return np.log(sum(w * p for w, p in zip(MIXTURE, (three, two, one, even), strict=True)))


def ratio_table(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each trigram, flat."""
    return (log_model(random_counts) - log_model(ordinary_counts)).astype(np.float32).ravel()


def best_stretches(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The largest sum of log-likelihood ratios over any stretch of each text."""
    if not texts:
        return np.zeros(0)
    codes = np.concatenate(([0, 0], _CODES[_packed(texts)]))
    first = np.where(codes[1:-1] == 0, 0, codes[:-2])
    ratios = table[(first * SIZE + codes[1:-1]) * SIZE + codes[2:]].astype(np.float64)
    ends = np.cumsum([len(t.encode()) + 1 for t in texts]) - 1
    best = []
    for begin, end in zip(np.concatenate(([0], ends[:-1] + 1)), ends, strict=True):
        total = np.cumsum(ratios[begin:end])
        lowest = np.minimum.accumulate(np.concatenate(([0.0], total[:-1]))) if len(total) else total
        best.append((total - lowest).max(initial=0.0))
    return np.array(best)


def fit(found: DataFrame) -> np.ndarray:
    """The ratio table from the counts in ``found``, which are summed by Spark: two trigram tables at most come back."""
    counts = found.where("random is not null").select("random", F.explode(F.arrays_zip("code", "n")).alias("x")).groupBy("random", "x.code").agg(F.sum("x.n").alias("n"))
    tables = {False: np.zeros(SIZE**3, np.int64), True: trigrams(_packed(random_strings()))}
    for r in counts.collect():
        tables[r.random][r.code] += r.n
    return ratio_table(tables[True], tables[False])


def _judge(table: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pc.list_parent_indices(batch.column("runs")).to_numpy()
            flat = pc.list_flatten(batch.column("runs"))
            score = best_stretches(flat.field("text").to_pylist(), table)
            start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            spans = [[dict(s, score=None) for s in have] for have in batch.column("spans").to_pylist()]
            for i in np.flatnonzero(score >= least):
                spans[rows[i]].append({"kind": "model", "start": int(start[i]), "end": int(end[i]), "score": float(score[i])})
            for row in np.unique(rows[score >= least]):
                spans[row].sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], ["id", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prior_odds: float = PRIOR_ODDS, least_run: int = LEAST_RUN) -> DataFrame:
    """id and ``spans`` of every document: kind, start, end (code points, end exclusive), score of model spans, in order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    found = materialise(rows.mapInArrow(_scan(least_run), f"id {kind.simpleString()}, {FOUND}"), "secret-found")
    table = fit(found)
    judged = found.where("random is null").select("id", "spans", "runs").mapInArrow(_judge(table, -float(np.log(prior_odds))), f"id {kind.simpleString()}, spans array<struct<kind:string,start:int,end:int,score:double>>")
    return judged.withColumnRenamed("id", id_col)


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with every stretch that spans cover replaced by ``mask``; spans that touch or overlap are one stretch."""
    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))
    return F.aggregate(ordered, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))

