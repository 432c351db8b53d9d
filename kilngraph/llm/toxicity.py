"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features are counted over whole texts in Arrow batches: densities of insults, profanity and threats, insults close to a
second-person word, capitals, punctuation and obfuscated spellings, and densities of a lexicon that is learned from the
labels, so that languages and words beyond the fixed lists count as well.

Learning uses a bounded sample: of the labelled rows that are not held out, at most ``SAMPLE_ROWS``, chosen by hash.

1. Lexicon: for every word, and every beginning of ``STEMS`` bytes of longer words, Spark counts the toxic and the clean
   sample texts it occurs in, by ``CROSS`` parts of the sample.  Entries of at least ``LEAST_TOXIC`` toxic texts and a
   log-odds of ``LEAST_ODDS`` or more are kept, the best ``LEXICON_ENTRIES`` of them.
2. Trees and calibration are fitted on the driver; only features (a few numbers a row) are collected.  A sample row's
   lexicon features use weights from the other parts of the sample (cross-fitting), so that trees see how the lexicon does
   on texts that it was not learned from.  Three quarters of the sample grow the trees, a quarter calibrates them.

Scoring is one pass without a shuffle.  Labels, language, source and id never enter a score.

Defined cases: null and empty texts have zero features and get the score of such texts; a null id counts as the id '' for
the fold; labels with null are ignored, of several labels for an id the largest counts; with no usable label the score is
0, with one class it is that class; an empty table gives an empty result; ``screen`` keeps further columns and never drops
a row for anything but its score; rows that repeat get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kilngraph.llm.storage import discard, fresh, materialise, slices

SAMPLE_ROWS = 20_000
FOLDS, HELD_FOLD = 5, 0
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 8
NEAR_WORDS = 6
#: The learned lexicon: parts of the sample, lengths of word beginnings, least toxic texts and log-odds, most entries.
CROSS, STEMS = 5, (4, 5, 6)
LEAST_TOXIC, LEAST_ODDS, LEXICON_ENTRIES = 3, 1.5, 8_000
#: Weight from which a word counts as a hit, and words whose weights a worker keeps.
HIT_ODDS, CACHE_WORDS = 2.5, 100_000

# The lexicons.
INSULTS = frozenset("""
    idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin loser losers scum scumbag trash garbage worthless pathetic disgusting clown clowns
    fool fools jerk creep coward freak pig pigs rat vermin parasite filth filthy ugly brainless useless retard retarded lunatic degenerate subhuman
    dummkopf trottel vollidiot blödmann arschloch abschaum dreckskerl versager schwachkopf depp
    imbécile crétin abruti connard connasse salaud ordure raclure minable débile
    imbécil estúpido estúpida tonto tonta basura escoria patético patética cabrón gilipollas inútil
    """.split())
PROFANITY = frozenset("""
    fuck fucks fucked fucking fucker motherfucker shit shits shitty bullshit bitch bitches bastard asshole assholes crap damn whore slut cunt dick prick
    scheisse scheiße ficken hure merde putain pute mierda puta joder coño
    """.split())
THREATS = frozenset("kill kills killing murder die dies hang shoot stab strangle burn destroy beat töten sterben tuer crève mourir matar muere morir".split())
SECOND_PERSON = frozenset("you your yours yourself youre ur u du dich dir dein deine euch tu toi te vous votre vos tú usted ustedes tus vosotros".split())

_LEXICON = {w.encode(): k for k, words in enumerate((INSULTS, PROFANITY, THREATS)) for w in words}
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)
_UPPER, _LETTER = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOUD, _SPACE, _DIGIT = b"!?", b" \t\n\r\x0b\x0c", b"0123456789"
#: Letters and everything beyond ASCII stay (A-Z lowered); all else separates words.
_WORDS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MASKED = re.compile(rb"(?<![a-zA-Z0-9@$!*+|])(?:[0-9@$!*+|]+[a-zA-Z]|[a-zA-Z]+[0-9@$!*+|])[a-zA-Z0-9@$!*+|]*[a-zA-Z]")
_SPACED = re.compile(rb"\b(?:[a-zA-Z][.\-_ ]){3,}[a-zA-Z]\b")
_LEET = bytes.maketrans(b"013457@$!|+", b"oieastasilt")
_RUNS = re.compile(rb"([a-z])\1{2,}")
FEATURES = (
    "log_words", "insults", "profanity", "threats", "insult_share", "profanity_share", "threat_share", "near_second", "second_share", "capitals", "punctuation", "loud", "digits", "masked_share", "masked_hits",
    "learned_hits", "learned_share", "learned_weight", "learned_best", "learned_second",
)


def entries(word: bytes) -> list[bytes]:
    """What stands for a word in the learned lexicon: itself, and its beginnings, marked by a hyphen."""
    return [word, *[word[:n] + b"-" for n in STEMS if len(word) > n]]


class Lexicon:
    """Log-odds of entries, one per part of the sample (learned without it) and one of all parts (the last)."""

    def __init__(self, odds: dict[bytes, tuple[float, ...]] | None = None):
        self.odds = odds or {}
        self.known: list[dict[bytes, float]] = [{} for _ in range(CROSS + 1)]

    def __getstate__(self) -> dict:
        return {"odds": self.odds}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["odds"])

    def weight(self, word: bytes, part: int = CROSS) -> float:
        """The largest log-odds of the word's entries, 0 without any."""
        known = self.known[part]
        found = known.get(word)
        if found is None:
            if len(known) >= CACHE_WORDS:
                known.clear()
            found = known[word] = max([0.0, *(self.odds[e][part] for e in entries(word) if e in self.odds)])
        return found


def features(text: bytes | None, lexicon: Lexicon | None = None, part: int = CROSS) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    text, lexicon = text or b"", lexicon or Lexicon()
    words = text.translate(_WORDS).split()
    n, size = max(len(words), 1), max(len(text), 1)
    hits = [(i, k) for i, k in enumerate(map(_LEXICON.get, words)) if k is not None]
    counts = [sum(k == kind for _, k in hits) for kind in range(3)]
    second = len([1 for w in words if w in _SECOND])
    near = sum(1 for i, k in hits if k < 2 and any(w in _SECOND for w in words[max(0, i - NEAR_WORDS) : i + NEAR_WORDS + 1]))
    masked = _MASKED.findall(text)
    plain = [m.lower().translate(_LEET) for m in masked] + [re.sub(rb"[^a-z]", b"", m.lower()) for m in _SPACED.findall(text)]
    hidden = sum(1 for w in plain if w in _LEXICON or w.replace(b"*", b"u") in _LEXICON or _RUNS.sub(rb"\1", w) in _LEXICON)
    without = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    letters = max(without(_LETTER), 1e-9)
    out = [float(np.log1p(len(words))), *map(float, counts), *[1000.0 * c / n for c in counts], float(near), 1000.0 * second / n, without(_UPPER) / letters if letters > 1e-9 else 0.0, without(_PUNCT), without(_LOUD), without(_DIGIT), 1000.0 * len(masked) / n, float(hidden)]
    found = [(x, c) for x, c in ((lexicon.weight(w, part), c) for w, c in Counter(words).items()) if x > 0] if lexicon.odds else []
    strong = sum(c for x, c in found if x >= HIT_ODDS)
    best = sorted((x for x, _ in found), reverse=True)[:2] + [0.0, 0.0]
    return [*out, float(strong), 1000.0 * strong / n, sum(x * c for x, c in found) / n, best[0], best[1]]


def feature_matrix(texts: Sequence[bytes | None], lexicon: Lexicon | None = None, parts: Sequence[int] | None = None) -> np.ndarray:
    rows = [features(t, lexicon, CROSS if parts is None else parts[i]) for i, t in enumerate(texts)]
    return np.array(rows, dtype=float).reshape(len(texts), len(FEATURES))


class BoostedTrees:
    """Logistic gradient boosting with shallow histogram trees; plain numpy, for samples of bounded size."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST_LEAF):
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1]), np.quantile(c[c > 0], np.linspace(0, 1, 9)) * (1 - 1e-9) if (c > 0).any() else []])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            tree: list[tuple] = []
            self._grow(tree, binned, cuts, y - p, p * (1 - p), np.arange(len(y)), 0, margin)
            self.trees.append(tree)
        return self

    def _grow(self, tree: list[tuple], binned, cuts, grad, hess, rows, level, margin) -> int:
        """Appends the node for ``rows`` and returns its index; a leaf is (None, value, 0, 0)."""
        g, h = grad[rows].sum(), hess[rows].sum()
        here, best = len(tree), (1e-6, None, None)
        tree.append(())
        if level < self.depth and len(rows) >= 2 * self.least:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b, n = binned[rows, f], len(cut) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                ok = (nl >= self.least) & (len(rows) - nl >= self.least)
                gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            value = self.rate * g / (h + 1)
            margin[rows] += value
            tree[here] = (None, value, 0, 0)
        else:
            _, f, at = best
            left = binned[rows, f] <= at
            a = self._grow(tree, binned, cuts, grad, hess, rows[left], level + 1, margin)
            b = self._grow(tree, binned, cuts, grad, hess, rows[~left], level + 1, margin)
            tree[here] = (f, cuts[f][at], a, b)
        return here

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                f, value, a, b = tree[node]
                if f is None:
                    out[rows] += value
                else:
                    left = x[rows, f] <= value
                    todo += [(a, rows[left]), (b, rows[~left])]
        return out


class Isotonic:
    """Non-decreasing step fit by pooling adjacent violators, read with linear interpolation between block centres."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        at, where = np.unique(margin, return_inverse=True)
        weight = np.bincount(where).astype(float)
        blocks: list[list[float]] = []  # value, weight, sum of places
        for place, total, w in zip(at, np.bincount(where, y), weight, strict=True):
            blocks.append([total / w, w, place * w])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v, w2, s = blocks.pop()
                u, w1, r = blocks.pop()
                blocks.append([(u * w1 + v * w2) / (w1 + w2), w1 + w2, r + s])
        self.at, self.value = np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.value), 0.0, 1.0)


class ToxicityModel:
    def __init__(self, constant: float | None = None, trees: BoostedTrees | None = None, isotonic: Isotonic | None = None):
        self.constant, self.trees, self.isotonic, self.lexicon = constant, trees, isotonic, Lexicon()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.trees is None else self.isotonic(self.trees.margin(x))

    def score(self, texts: Sequence[bytes | None]) -> np.ndarray:
        return self(feature_matrix(texts, self.lexicon))


def fit_model(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> ToxicityModel:
    """``part`` 0 of 4 calibrates, the rest grows trees; too small or one-sided a part falls back to all rows."""
    if not len(y):
        return ToxicityModel(0.0)
    if y.min() == y.max():
        return ToxicityModel(float(y[0]))
    grow, hold = part != 0, part == 0
    if min(y[grow].sum(), (1 - y[grow]).sum(), y[hold].sum(), (1 - y[hold]).sum()) < 10:
        grow = hold = np.ones(len(y), dtype=bool)
    trees = BoostedTrees().fit(x[grow], y[grow])
    return ToxicityModel(trees=trees, isotonic=Isotonic().fit(trees.margin(x[hold]), y[hold]))


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lexicon entries of each sample text, with its part and label."""
    for whole in batches:
        for batch in slices(whole, "text", 500_000):
            out: list[tuple[bytes, int, float]] = []
            for text, cross, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("cross").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = {e for w in set((text or b"").translate(_WORDS).split()) for e in entries(w)}
                out += [(e, cross, label) for e in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.float64()))], ["entry", "cross", "label"])


def learn_lexicon(sample: DataFrame, most: int = LEXICON_ENTRIES) -> Lexicon:
    """The lexicon of a sample with columns text, cross and label; at most ``most`` entries reach the driver."""
    sizes = {(r.cross, r.label > 0): r["count"] for r in sample.groupBy("cross", "label").count().collect()}
    if not any(y for _, y in sizes) or all(y for _, y in sizes):
        return Lexicon()
    toxic, clean = ([sizes.get((p, y), 0) for p in range(CROSS)] for y in (True, False))
    counts = [F.count_if((F.col("cross") == p) & (F.col("label") == y)).alias(f"{'t' if y else 'c'}{p}") for y in (1, 0) for p in range(CROSS)]
    found = sample.select("text", "cross", "label").mapInArrow(_entries, "entry binary, cross int, label double").groupBy("entry").agg(*counts)
    total = lambda kind: sum((F.col(f"{kind}{p}") for p in range(CROSS)), F.lit(0))
    odds = F.log((total("t") + 0.5) / (sum(toxic) + 1)) - F.log((total("c") + 0.5) / (sum(clean) + 1))
    found = found.withColumns({"odds": odds, "toxic": total("t")}).where((F.col("toxic") >= LEAST_TOXIC) & (F.col("odds") >= LEAST_ODDS))
    got = found.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "entry").limit(most).collect()

    def weights(r) -> tuple[float, ...]:
        out = []
        for left in range(CROSS + 1):
            parts = [p for p in range(CROSS) if p != left]
            t, c, n_t, n_c = (sum(x[p] for p in parts) for x in ([r[f"t{p}"] for p in range(CROSS)], [r[f"c{p}"] for p in range(CROSS)], toxic, clean))
            value = float(np.log((t + 0.5) / (n_t + 1)) - np.log((c + 0.5) / (n_c + 1)))
            out.append(value if t >= LEAST_TOXIC and value >= LEAST_ODDS else 0.0)
        return tuple(out)

    return Lexicon({bytes(r.entry): weights(r) for r in got})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled ids outside the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD_FOLD)).groupBy(F.col(id_col).alias("label_id")).agg(F.max((F.col(label_col) > 0).cast("double")).alias("label"))
    known = known.withColumn("order", F.xxhash64(F.lit("toxicity sample"), "label_id")).orderBy("order", "label_id").limit(sample_rows)
    side = F.broadcast(known.select("label_id", "label", F.pmod("order", F.lit(4)).cast("int").alias("part"), F.pmod(F.xxhash64("order"), F.lit(CROSS)).cast("int").alias("cross")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(side, F.col("id") == F.col("label_id"))
    # Rows that repeat an id would lift the sample over its bound: the first text of an id in text order counts.
    sample = materialise(rows.groupBy("id").agg(F.min(F.struct("text", "label", "part", "cross")).alias("r")).select("r.*"), "toxicity-sample")
    lexicon = learn_lexicon(sample)
    got = sample.mapInArrow(_tagged(docs.sparkSession.sparkContext.broadcast(lexicon)), "x array<double>, label double, part int").collect()
    discard(sample)
    x = np.array([r.x for r in got], dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort(x.T) if len(got) else []
    y, part = np.array([r.label for r in got]), np.array([r.part for r in got])
    model = fit_model(x[order], y[order], part[order])
    model.lexicon = lexicon
    return model


def _tagged(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = feature_matrix(batch.column("text").cast(pa.binary()).to_pylist(), lexicon.value, batch.column("cross").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label"), batch.column("part")], ["x", "label", "part"])

    return run


def scorer(spark, model: ToxicityModel):
    """A column function text -> score; the model is a broadcast of a few hundred kilobytes at most."""
    shared = spark.sparkContext.broadcast(model)

    def score(text: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([text], ["text"])
        parts = [shared.value.score(b.column("text").cast(pa.binary()).to_pylist()) for b in slices(whole, "text")]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return F.arrow_udf(score, DoubleType())


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, held_out, score and predicted."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col, **options))
    rows = docs.select(id_col, (fold(id_col) == HELD_FOLD).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def screen(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, reject_at: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject_at``, all columns unchanged."""
    name = fresh(docs.columns, "__score")
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col, **options))
    return docs.withColumn(name, score(F.col(text_col))).where(F.col(name) < reject_at).select(docs.columns)
