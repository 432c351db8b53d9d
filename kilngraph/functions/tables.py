"""Markdown and HTML tables as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilngraph.functions.text import bound, strip

_UNIT = "\\(([^)]+)\\)$"


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(line, "^\\|+", ""), "\\|+$", "")
    return F.transform(F.split(inner, "\\|"), strip)


def table_rows(markdown: Column) -> Column:
    """Cells of every table line; separator lines are dropped, so the first row is the header."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), strip), lambda x: x.startswith("|") & ~x.rlike("^[|\\-: ]+$"))
    return F.transform(lines, _cells)


def parse_markdown(markdown: Column) -> Column:
    """struct(headers, rows, row_count, col_count), or null without a table line."""

    def shaped(rows: Column) -> Column:
        headers = F.element_at(rows, 1)
        body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
        return F.when(F.size(rows) > 0, F.struct(headers.alias("headers"), body.alias("rows"), (F.size(rows) - 1).alias("row_count"), F.size(headers).alias("col_count")))

    # Bound, so that the lines of a table are split once.
    return bound(table_rows(markdown), shaped)


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def html_to_markdown(html: Column) -> Column:
    """The cells of every row of an HTML table as Markdown; text without a table is returned as it is, no rows give ''."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: strip(F.regexp_replace(c, "<[^>]+>", ""))))
    cells = F.filter(cells, lambda r: F.size(r) > 0)
    lines = F.transform(cells, _line)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(cells, 1), lambda c: F.lit("---")), " | "), F.lit(" |"))
    text = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when(~F.lower(html).contains("<table"), html).when(F.size(cells) == 0, F.lit("")).otherwise(text)


def embed_units(markdown: Column) -> Column:
    """Move a header's "(unit)" behind every value with a digit in its column."""

    def row(line: Column, units: Column) -> Column:
        return _line(F.transform(_cells(line), lambda c, i: F.when(F.get(units, i).isNotNull() & c.rlike("\\d"), F.concat(c, F.get(units, i))).otherwise(c)))

    def moved(lines: Column, headers: Column, units: Column) -> Column:
        head = _line(F.transform(headers, lambda h: strip(F.regexp_replace(h, "\\s*\\([^)]+\\)$", ""))))
        body = F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), lambda line: row(line, units))
        text = F.array_join(F.concat(F.array(head, F.element_at(lines, 2)), body), "\n")
        return F.when((F.size(lines) < 2) | ~F.exists(units, lambda u: u.isNotNull()), markdown).otherwise(text)

    units_of = lambda headers: F.transform(headers, lambda h: F.nullif(F.regexp_extract(h, _UNIT, 1), F.lit("")))
    # Bound, so that the lines and units of a table are found once and not again for each of its cells.
    return bound(F.split(strip(markdown), "\n"), lambda lines: bound(_cells(F.element_at(lines, 1)), lambda headers: bound(units_of(headers), lambda units: moved(lines, headers, units))))


def split_rows(markdown: Column, most: int = 8) -> Column:
    """Tables of at most ``most`` data rows each, every one with the header lines."""

    def parts(lines: Column) -> Column:
        n = F.size(lines) - 2
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(most))
        cut = F.transform(starts, lambda i: F.array_join(F.concat(F.slice(lines, 1, 2), F.slice(lines, i + 3, F.lit(most))), "\n"))
        return F.when(n <= most, F.array(markdown)).otherwise(cut)

    return bound(F.split(strip(markdown), "\n"), parts)


def table_result(markdown: Column, html: Column, page: Column, ordinal: Column, published: bool = False) -> Column:
    """A recognised table as struct(table_id, page_num, headers, rows, markdown, row_count, col_count), null if it is blank.

    Recognised Markdown is taken before HTML.  Tables of a page are numbered; ``published`` gives all of them number 00.
    """
    text = F.coalesce(F.nullif(markdown, F.lit("")), html_to_markdown(F.coalesce(html, F.lit(""))))
    number = F.format_string("tbl_p%d_%02d", page, F.lit(0) if published else ordinal.cast("int"))

    def shaped(md: Column, r: Column) -> Column:
        return F.struct(
            number.alias("table_id"),
            page.cast("int").alias("page_num"),
            F.coalesce(r["headers"], F.array().cast("array<string>")).alias("headers"),
            F.coalesce(r["rows"], F.array().cast("array<array<string>>")).alias("rows"),
            md.alias("markdown"),
            F.coalesce(r["row_count"], F.lit(0)).alias("row_count"),
            F.coalesce(r["col_count"], F.lit(0)).alias("col_count"),
        )

    return bound(text, lambda md: F.when(strip(md) != "", bound(parse_markdown(md), lambda r: shaped(md, r))))
