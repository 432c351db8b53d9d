"""Text cleaning, noise tests, numbers and chunk building as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed

CJK = "[\\x{4e00}-\\x{9fff}]"
#: The characters with the property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not only U+0020."""
    return F.btrim(text, F.lit(BLANKS))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def fix_known_errors(text: Column, pairs: list[tuple[str, str]] = fixed.TEXT_FIXES) -> Column:
    """Literal replacements, one after the other, the longest wrong form first."""
    for wrong, right in sorted(pairs, key=lambda p: -len(p[0])):
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def worth_keeping(line: Column) -> Column:
    """Whether a trimmed line is neither empty nor garbled nor meaningless.

    A CJK character counts twice towards the useful share, as it is also alphanumeric.
    """
    cjk, alnum, size = count_of(line, CJK), count_of(line, "[\\p{L}\\p{N}]"), F.length(line)
    garbled = (size > 5) & ((cjk + alnum) / size < 0.1)
    meaningless = (size < 3) & (cjk == 0) & (alnum == 0)
    return (size > 0) & ~garbled & ~meaningless


def clean_line(line: Column) -> Column:
    """The trimmed line, or null for one that is not worth keeping."""
    return bound(strip(line), lambda x: F.when(worth_keeping(x), x))


def clean_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), worth_keeping), "\n")


def normalise(text: Column) -> Column:
    """Collapse blank lines, close up blanks between CJK characters (line breaks too), unify dashes."""
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    text = F.regexp_replace(text, f"(?U)(?<={CJK})\\s+(?={CJK})", "")
    return F.replace(F.replace(text, F.lit("——"), F.lit("—")), F.lit("--"), F.lit("—"))


def clean(text: Column) -> Column:
    """Known errors, lines, normal form, trim; null and empty give ''."""
    return F.coalesce(strip(normalise(clean_lines(fix_known_errors(text)))), F.lit(""))


def is_noise(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    cjk = count_of(text, CJK)
    bare = (cjk == 0) & (count_of(text, "-?\\d+\\.?\\d*") < 2)
    thin = (cjk / F.greatest(F.length(strip(text)), F.lit(1)) < 0.03) & (F.length(text) < 100)
    return (F.length(text) < 10) | bare | thin


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(-?\\d+\\.?\\d*)"), 1), lambda x: x.cast("double"))


def allowed_only(text: Column) -> Column:
    """Drop every character outside CJK, CJK punctuation, full-width forms, word characters, blanks and common marks."""
    return F.regexp_replace(text, "(?U)[^\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}\\w\\s.,%\\-+/()\\[\\]\\x{2100}-\\x{214f}]+", "")


def keep_chunk(text: Column) -> Column:
    return (F.length(strip(text)) >= 20) & ~is_noise(text)


def strip_page_frame(text: Column, header: int = 1, footer: int = 1) -> Column:
    """Drop the first and last lines of a page that has more lines than these and one."""
    lines = F.split(text, "\n")
    inner = F.slice(lines, F.lit(header + 1), F.size(lines) - header - footer)
    return F.when(F.size(lines) > header + footer + 1, F.array_join(inner, "\n")).otherwise(text)


def table_context(file: Column, page: Column) -> Column:
    return F.concat(F.lit("来自 "), file, F.lit(" 第"), F.coalesce(page, F.lit(0)).cast("string"), F.lit("页"))


# --- chunks --------------------------------------------------------------------------------------------------------


def pieces(text: Column, separators: list[str] = fixed.SEPARATORS) -> Column:
    """Stripped non-blank pieces by the first separator that gives more than one; else null."""
    cut = lambda s: bound(F.filter(F.transform(F.split(text, f"\\Q{s}\\E"), strip), lambda p: p != ""), lambda t: F.when(F.size(t) > 1, t))
    return F.coalesce(*[F.when(F.contains(text, F.lit(s)), cut(s)) for s in separators])


def force_split(text: Column, size: int, overlap: int) -> Column:
    """Slices of ``size`` every ``size - overlap`` characters, stripped, blanks dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size)))), lambda p: p != "")


def merge_pieces(parts: Column, size: int, overlap: int) -> Column:
    """Greedy fold: join pieces with a line break while they fit; a later piece that is too long is force-split.

    The first piece is never force-split, so a chunk may exceed ``size`` when the text opens with one long piece.
    """
    empty = F.array().cast("array<string>")

    def add(state: Column, piece: Column) -> Column:
        out, cur = state["out"], state["cur"]
        fits = F.length(cur) + F.length(piece) + 1 <= size
        closed = F.concat(out, F.array(cur))
        long = lambda slices: F.struct(F.concat(closed, F.slice(slices, F.lit(1), F.greatest(F.size(slices) - 1, F.lit(0)))).alias("out"), F.element_at(slices, -1).alias("cur"))
        return (
            F.when(cur.isNull(), F.struct(out.alias("out"), piece.alias("cur")))
            .when(fits, F.struct(out.alias("out"), F.concat(cur, F.lit("\n"), piece).alias("cur")))
            .when(F.length(piece) > size, bound(force_split(piece, size, overlap), long))
            .otherwise(F.struct(closed.alias("out"), piece.alias("cur")))
        )

    start = F.struct(empty.alias("out"), F.lit(None).cast("string").alias("cur"))
    return F.aggregate(parts, start, add, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def chunks(text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, separators: list[str] = fixed.SEPARATORS) -> Column:
    """Chunks of a text as an array; a blank text has none, a short one is one chunk as it is."""
    text = F.coalesce(text, F.lit(""))
    split = lambda parts: F.when(parts.isNull(), force_split(text, size, overlap)).otherwise(merge_pieces(parts, size, overlap))
    return F.when(strip(text) == "", F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(bound(pieces(text, separators), split))
