"""Tables as arrays of rows of cells: checks, and Markdown or HTML of them, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGE_ROWS = 40


def cell(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\xa0"), F.lit(" ")), r"[\t-\r ]+", " "))


def rows_of_pipes(md: Column) -> Column:
    """The rows of a pipe table without its ruler; other lines are left out."""
    lines = F.filter(F.split(md, "\n"), lambda x: x.rlike(r"^\|") & ~x.rlike(r"^\|[-| :]+\|?$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|[ ]*|[ ]*\|[ ]*$", ""), r"[ ]*\|[ ]*"), cell))


def width(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size))


def ragged(rows: Column) -> Column:
    return width(rows) != F.array_min(F.transform(rows, F.size))


def empty_ratio(rows: Column) -> Column:
    """Share of empty cells, rounded to three places; halves to even."""
    cells = F.flatten(rows)
    return F.bround(F.size(F.filter(cells, lambda c: cell(c) == "")) / F.greatest(F.size(cells), F.lit(1)), 3)


def empty_headers(rows: Column) -> Column:
    return F.size(F.filter(rows[0], lambda c: cell(c) == ""))


def padded(rows: Column) -> Column:
    w = width(rows)
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), (w - F.size(r)).cast("int"))))


def to_pipes(rows: Column) -> Column:
    """Pipe table; pipes in cells escaped, short rows filled up."""
    lines = F.transform(padded(rows), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(cell(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    ruler = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width(rows)), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(ruler), F.slice(lines, 2, 1_000_000_000)), "\n")


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_html(rows: Column) -> Column:
    """HTML table; the first row is the head."""
    def line(r: Column, i: Column) -> Column:
        tag = F.when(i == 0, "th").otherwise("td")
        return F.concat(F.lit("  <tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), escaped(cell(c)), F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))

    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(rows, line), "\n"), F.lit("\n</table>"))
