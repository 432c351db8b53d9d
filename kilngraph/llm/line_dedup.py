"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's set is its distinct words (runs of anything but U+0020 and U+0009-U+000D, lower-cased).  Lines are ordered by
(id, text hash, line number).  A line is removed if an earlier line has a Jaccard similarity of 4/5 or more with it.

1. Lines with equal lower-cased text form a class; its first line stands for it, every later one is removed.  The shuffle
   that finds them carries the text, which is shorter than its words' hashes.  A class is stored with its words' 64-bit
   hashes, distinct and sorted; all later steps compare these.
2. Near copies are settled first, without forming their pairs: classes that share one of up to four keys (three
   neighbouring word hashes from the low or high end) are compared with the earliest class under that key.
3. The words of a class are ordered by rarity.  Rarity is read from word counts over all classes in a hashed table of
   fixed size; words that share an entry are ordered by hash.  Any fixed order gives exact results.
4. Prefix filter: of two similar lines, the smaller has a common word among its n - ceil(8n/9) + 1 rarest, the larger
   among its n - ceil(4n/5) + 1 rarest.  Every class that is not settled meets all earlier classes under these words (a
   word that occurs once meets nothing and is left out); a pair must pass the length filter, the positional filter, and a
   parity filter: each word flips one of 128 bits, and as many bits as differ must fit into the allowed difference.
5. Candidate pairs are verified on the full word sets, after one more parity filter on other bits of the hashes.

Defined cases: a null text is the empty text; lines without words stay; a null id ranks first; rows that repeat id and
text are one document, reported each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.llm.storage import discard, materialise

#: Similar means intersection * SHARE[1] >= union * SHARE[0].
SHARE = (4, 5)
#: Entries of the rarity table.  It is part of the plan, which the driver holds and logs many times over, so it stays small.
RARITY_ENTRIES = 1 << 17
#: Entries of the rarity table that one 64-bit number holds, and the bits of each.
PACKED, LEVEL_BITS = 16, 4
#: Bits of a word's hash that serve as join key below its rarity.
KEY_BITS = 64 - LEVEL_BITS
#: Tables of at most so many rows of one number are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
SPACE, NOT_BLANK = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"
#: Blanks inside a line other than U+0020.
OTHER_BLANKS = "\t\x0b\x0c\r"


def word_set(line: Column) -> Column:
    """Distinct 64-bit hashes of the words of a lower-cased line that has any, sorted."""
    other = F.lit(False)
    for blank in "\n" + OTHER_BLANKS:
        other = other | F.contains(line, F.lit(blank))
    # A split by one plain character takes a sixth of the time of one by a class; its empty words go by their hash.
    words = F.split(F.when(other, F.regexp_replace(line, SPACE, " ")).otherwise(line), " ")
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))))


def _if_few(df: DataFrame) -> DataFrame:
    """A broadcast hint for a written table whose row count is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _parity(skip: int, name: str) -> dict[str, Column]:
    """128 bits in two columns: each word flips the bit that seven bits of its hash name, after the lowest ``skip``."""
    flip = f"a ^ shiftleft(1L, cast({f'shiftright(w, {skip})' if skip else 'w'} & 63 as int))"
    upper = f"if(w & {1 << (skip + 6)}L = 0L, a, {flip})"
    return {f"{name}{i}": F.expr(f"aggregate(words, 0L, (a, w) -> {step})") for i, step in ((1, flip), (2, upper))}


def _differ(x: str, y: str) -> Column:
    """Bits that differ between columns x1, x2 and y1, y2 of ``_parity``."""
    one, two = (F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}")) for i in (1, 2))
    return F.bit_count(two) + F.bit_count(one.bitwiseXOR(two))


def _keys(n: Column) -> Column:
    """Hashes of three neighbouring words: the two lowest and the two highest threes."""
    three = [F.xxhash64(F.lit(i), F.slice("words", start, 3)) for i, start in enumerate((1, 4, -3, -6))]
    return F.when(n > 5, F.array(*three)).when(n > 3, F.array(three[0]))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cid, words, n, two parity words, keys of near copies and the place (id, doc, line_no) of the first line of each class."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = rows.select("id", F.xxhash64("text").alias("doc"), F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line")).where(F.col("line").rlike(NOT_BLANK))
    named = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    first = named.groupBy("h1", "h2").agg(F.min(F.struct("id", "doc", "line_no", "line")).alias("f"))
    first = first.select("f.id", "f.doc", "f.line_no", word_set(F.col("f.line")).alias("words"))
    return materialise(first.withColumns({"n": F.size("words"), **_parity(0, "p"), "keys": _keys(F.size("words")), "cid": F.monotonically_increasing_id()}), "line-classes", compression="zstd")


def _alike(x: str, y: str) -> Column:
    """Length and parity filters for columns n, p1 and p2 with prefixes x and y."""
    num, den = SHARE
    n_x, n_y = F.col(f"{x}n").cast("long"), F.col(f"{y}n").cast("long")
    return (den * F.least(n_x, n_y) >= num * F.greatest(n_x, n_y)) & ((num + den) * (n_x + n_y - _differ(f"{x}p", f"{y}p")) >= 2 * num * (n_x + n_y))


def _settled(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The later class of every pair whose full word sets are similar; ``pairs`` is a written table of cids a, b in any order, or a part of one."""
    wanted = materialise(pairs.select(F.col("a").alias("want")).unionByName(pairs.select(F.col("b").alias("want"))).distinct(), "line-wanted")
    sets = materialise(classes.join(_if_few(wanted), F.col("cid") == F.col("want"), "left_semi").select("cid", "id", "doc", "line_no", "n", "words", *[v.alias(k) for k, v in _parity(7, "p").items()]), "line-sets", compression="zstd")
    # One more parity filter, on other bits of the hashes, so that few pairs carry word sets through a shuffle.
    rows = pairs
    for c in ("a", "b"):
        rows = rows.join(sets.select(F.col("cid").alias(f"cid_{c}"), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "p1", "p2")]), F.col(c) == F.col(f"cid_{c}"))
    rows = rows.where(_alike("a_", "b_")).select("a", "b")
    for c in ("a", "b"):
        side = sets.select(F.col("cid").alias(f"cid_{c}"), F.struct("id", "doc", "line_no").alias(f"at_{c}"), F.col("words").alias(f"set_{c}"))
        rows = rows.join(side, F.col(c) == F.col(f"cid_{c}")).drop(f"cid_{c}")
    both = F.size(F.array_intersect("set_a", "set_b"))
    similar = (SHARE[0] + SHARE[1]) * both >= SHARE[0] * (F.size("set_a") + F.size("set_b"))
    later = F.when(F.col("at_a") > F.col("at_b"), F.col("a")).when(F.col("at_b") > F.col("at_a"), F.col("b"))
    found = materialise(rows.where(similar).select(later.alias("done")).where("done is not null").distinct(), "line-settled")
    discard(wanted, sets)
    return found


def _near_copies(classes: DataFrame) -> DataFrame:
    """cids (done) of classes that the earliest class under one of their keys is similar to."""
    rows = classes.select(F.explode("keys").alias("key"), "id", "line_no", "cid", "n", "p1", "p2")
    # The first row under a key is its earliest class: one shuffle and one sort find it and meet it with the others.
    under = Window.partitionBy("key").orderBy("id", "line_no", "cid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"h_{c}": F.first(c).over(under) for c in ("cid", "n", "p1", "p2")})
    pairs = rows.where((F.col("cid") != F.col("h_cid")) & _alike("", "h_"))
    pairs = materialise(pairs.select(F.col("cid").alias("a"), F.col("h_cid").alias("b")).distinct(), "line-stars")
    found = _settled(classes, pairs)
    discard(pairs)
    return found


def _entry(word: Column) -> Column:
    return word.bitwiseAND(RARITY_ENTRIES - 1)


def _rarity(classes: DataFrame) -> Callable[[Column], Column]:
    """Level of a word by its entry's word count, as a function: 0 for an entry counted once, then 1 to 15 by powers of 2 about the mean."""
    words = classes.select(F.explode("words").alias("w")).groupBy(_entry(F.col("w")).cast("int").alias("entry")).agg(F.count("*").alias("n"))
    counts = words.collect()  # at most RARITY_ENTRIES rows
    mean = sum(n for _, n in counts) / max(1, len(counts))
    table = [0] * (RARITY_ENTRIES // PACKED)
    for entry, n in counts:
        level = 0 if n == 1 else min(15, max(1, math.floor(math.log2(n / mean)) + 4))
        table[entry // PACKED] |= level << LEVEL_BITS * (entry % PACKED)
    packed = F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in table)), ",").cast("array<bigint>")
    return lambda w: F.call_function("shiftright", F.get(packed, F.shiftright(_entry(w), 4).cast("int")), (w.bitwiseAND(PACKED - 1) * LEVEL_BITS).cast("int"))


#: Places of n, pos and the two flags in a posting's packed number.
_N, _POS = 28, 2


def _prefixes(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """word, cid, two parity words, info for each prefix word; info holds n, pos, whether open, whether in the short prefix."""
    num, den = SHARE
    level = _rarity(classes)
    # The shift to the left drops the other entries; turning the highest bit makes signed order that of the levels.
    key = lambda w: F.shiftleft(level(w), KEY_BITS).bitwiseXOR(F.lit(-(1 << 63))).bitwiseOR(F.shiftrightunsigned(w, LEVEL_BITS))
    rows = classes.join(_if_few(settled), F.col("cid") == F.col("done"), "left")
    n = F.col("n").cast("long")
    up = lambda a, b: F.floor((a * n + (b - 1)) / F.lit(b)).cast("int")  # noqa: E731  a * n / b, rounded up
    length, short = n.cast("int") - up(num, den) + 1, n.cast("int") - up(2 * num, num + den) + 1
    rows = rows.select("cid", "n", "p1", "p2", short.alias("short"), F.col("done").isNull().cast("long").alias("open"), F.posexplode(F.slice(F.sort_array(F.transform("words", key)), F.lit(1), length)).alias("pos", "word"))
    once = F.shiftright("word", KEY_BITS) == -(1 << LEVEL_BITS - 1)
    info = F.shiftleft(n, _N).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), _POS)).bitwiseOR(F.col("open") * 2).bitwiseOR((F.col("pos") < F.col("short")).cast("long"))
    return rows.where(~once).select("word", "cid", "p1", "p2", info.alias("info"))


def _similar_to_earlier(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """cids (done) of open classes that any earlier class is similar to."""
    num, den = SHARE
    index = _prefixes(classes, settled)
    x, y = (index.select(*[F.col(c).alias(f"{s}{c}") for c in index.columns]) for s in ("x_", "y_"))
    part = lambda s: {"n": F.shiftright(F.col(f"{s}info"), _N), "pos": F.shiftright(F.col(f"{s}info"), _POS).bitwiseAND((1 << (_N - _POS)) - 1), "open": F.col(f"{s}info").bitwiseAND(2), "short": F.col(f"{s}info").bitwiseAND(1)}
    a, b = part("x_"), part("y_")
    # No condition is on one side alone and both sides read the same columns, so one shuffle serves both.
    # A pair is met once, in the order of cids; which class is later is seen when their sets are compared.
    once = (F.col("x_cid") > F.col("y_cid")) & (a["open"] + b["open"] > 0)
    larger = a["n"] >= b["n"]
    sized = (F.when(larger, b["short"]).otherwise(a["short"]) == 1) & (den * F.least(a["n"], b["n"]) >= num * F.greatest(a["n"], b["n"]))
    overlap = 1 + F.least(a["n"] - 1 - a["pos"], b["n"] - 1 - b["pos"])
    fits = (num + den) * overlap >= num * (a["n"] + b["n"])
    near = (num + den) * (a["n"] + b["n"] - _differ("x_p", "y_p")) >= 2 * num * (a["n"] + b["n"])
    # The parity filter comes early: most rows under a word fail it.
    pairs = x.join(y, (F.col("x_word") == F.col("y_word")) & near & once & sized & fits)
    pairs = materialise(pairs.select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b")).distinct(), "line-pairs")
    found = _settled(classes, pairs)
    discard(pairs)
    return found


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_removed and the text of the lines that stay."""
    classes = _classes(docs, id_col, text_col)
    copies = _near_copies(classes)
    gone = materialise(copies.unionByName(_similar_to_earlier(classes, copies)).distinct(), "line-gone")
    stay = classes.select("cid", "id", "doc", "line_no").join(_if_few(gone), F.col("cid") == F.col("done"), "left_anti")
    stay = materialise(stay.groupBy(F.col("id").alias("stay_id"), F.col("doc").alias("stay_doc")).agg(F.collect_list("line_no").alias("stay")), "line-stay")
    discard(classes, copies, gone)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("doc"), text.alias("text"))
    rows = rows.join(stay, (F.col("doc") == F.col("stay_doc")) & F.col("id").eqNullSafe(F.col("stay_id")), "left").withColumn("lines", F.split("text", "\n"))
    blank = F.filter(F.transform("lines", lambda line, i: F.when(~line.rlike(NOT_BLANK), i)), lambda i: i.isNotNull())
    kept = F.array_sort(F.concat(blank, F.coalesce("stay", F.array().cast("array<int>"))))
    rows = rows.select("id", "lines", kept.alias("kept"))
    n_lines = F.size("lines").cast("long")
    return rows.select(F.col("id").alias(id_col), n_lines.alias("n_lines"), (n_lines - F.size("kept")).alias("n_removed"), F.array_join(F.transform("kept", lambda i: F.element_at(F.col("lines"), i + 1)), "\n").alias("text"))
