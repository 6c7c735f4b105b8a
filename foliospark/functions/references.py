"""Citations and cross-references in Markdown, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms in which references are written.
FENCED = r"(?s)```.*?(?:```|$)"
CODE = r"`[^`\n]*`"
DISPLAY = r"(?s)\$\$.*?\$\$"
FORMULA = r"\$[^$\n]+\$"
LINK_TARGET = r"\]\([^()\n]*\)"
CITATION = r"\[([0-9]{1,9}(?:[ \x{A0}]*[,;\-‐‑–—−][ \x{A0}]*[0-9]{1,9})*)\]"
RANGE = r"^([0-9]+)[-‐‑–—−]([0-9]+)$"
CHAPTER = r"(?:^|[^A-Za-z])(?:Chapters?|Chap\.)[ \x{A0}\x{2007}\x{2009}\x{202F}]*([0-9]{1,9})"
NUMBERED = r"(?:^|[^A-Za-z])(?:Tables?|Figures?|Figs?\.)[ \x{A0}\x{2007}\x{2009}\x{202F}]*([0-9]{1,9})\.[0-9]"

#: So many numbers of a range are made at once.
CHUNK = 32_768


def prose(md: Column) -> Column:
    """Markdown without code, formulas and link targets; link labels stay. A text is searched only for what its marks say it may hold."""
    for mark, patterns, by in (("`", (FENCED, CODE), " "), ("$", (DISPLAY, FORMULA), " "), ("](", (LINK_TARGET,), "]")):
        plain = md
        for pattern in patterns:
            plain = F.regexp_replace(plain, pattern, by)
        md = F.when(F.contains(md, F.lit(mark)), plain).otherwise(md)
    return md


def cited_ranges(text: Column) -> Column:
    """What is cited in square brackets: array of (lo, hi), repeated ones once. A number alone is a range of one; the two ends of a range that
    goes down are two numbers."""
    groups = F.when(F.contains(text, F.lit("[")), F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))).when(text.isNotNull(), F.array().cast("array<string>"))
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"[ \x{A0}]", ""), "[,;]")))

    def pair(lo: Column, hi: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    def bounds(p: Column) -> Column:
        lo, hi = (F.regexp_extract(p, RANGE, i).try_cast("int") for i in (1, 2))
        one = p.try_cast("int")
        return (
            F.when(~p.rlike("[^0-9]"), F.array(pair(one, one)))
            .when(lo.isNull() | hi.isNull(), F.transform(F.split(p, "[^0-9]+"), lambda x: pair(x.try_cast("int"), x.try_cast("int"))))
            .when(lo <= hi, F.array(pair(lo, hi)))
            .otherwise(F.array(pair(lo, lo), pair(hi, hi)))
        )

    return F.array_distinct(F.filter(F.flatten(F.transform(parts, bounds)), lambda r: r["lo"].isNotNull()))


def explode_range(df: DataFrame, lo: str, hi: str, no: str) -> DataFrame:
    """A row for each number of each row's range, as ``no`` in place of ``lo`` and ``hi``; no array is longer than a chunk, however wide the
    range."""
    chunks = df.withColumn("__at", F.explode(F.sequence(lo, hi, F.lit(CHUNK))))
    return chunks.withColumn(no, F.explode(F.sequence("__at", F.least(F.col(hi), F.col("__at") + (CHUNK - 1))))).drop(lo, hi, "__at")


def chapter_numbers(text: Column) -> Column:
    """Chapter numbers named by Chapter N, Table N.M and Figure N.M: array of int, repeated ones once."""
    none = F.array().cast("array<string>")
    named = F.when(F.contains(text, F.lit("Chap")), F.regexp_extract_all(text, F.lit(CHAPTER), F.lit(1))).otherwise(none)
    numbered = F.when(F.contains(text, F.lit("Table")) | F.contains(text, F.lit("Fig")), F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1))).otherwise(none)
    found = F.when(text.isNotNull(), F.concat(named, numbered))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
