"""Chapters of a book: from an outline, from large headings, or the whole book; their pages, checks and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import clean_title
from foliospark.operators.layout import blocks_of, body_size


def outline_level(toc: DataFrame) -> DataFrame:
    """(book_id, level): the outline level whose entries are chapters. The first of the three highest levels is kept unless another has at least
    two entries and a share of numbered titles that is higher by more than 0.2: a fold over at most three rows a book."""
    number, _ = clean_title(F.col("title"))
    levels = toc.groupBy("book_id", "level").agg(F.count("*").alias("n"), F.avg(F.when(number.isNotNull(), 1.0).otherwise(0.0)).alias("share"))
    lists = levels.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("level", "n", "share"))).alias("l"))
    start = F.struct(F.col("l")[0]["level"].alias("level"), F.lit(-1.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        better = (x["share"] > acc["best"] + 0.2) & (x["n"] >= 2)
        return F.struct(F.when(better, x["level"]).otherwise(acc["level"]).alias("level"), F.when(better, x["share"]).otherwise(acc["best"]).alias("best"))

    return lists.select("book_id", F.aggregate(F.slice("l", 1, 3), start, step, lambda a: a["level"]).alias("level"))


def from_outline(toc: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, seq, number, title, start_page, end_page, confidence): chapters of the outline; each ends before the next begins. The first of
    equal start page and title counts."""
    rows = toc.join(outline_level(toc), ["book_id", "level"]).where("page >= 1").join(books.select("book_id", "page_count"), "book_id")
    w = Window.partitionBy("book_id").orderBy("seq")
    number, title = clean_title(F.col("title"))
    following = F.lead("page").over(w)
    end = F.least(F.greatest("page", F.coalesce(following - 1, "page_count")), F.coalesce("page_count", F.lit(1 << 30)))
    rows = rows.select("book_id", "seq", F.coalesce(number, F.row_number().over(w)).alias("number"), title.alias("title"), F.col("page").alias("start_page"), end.alias("end_page"), F.when(number.isNotNull(), 0.95).otherwise(0.8).alias("confidence"))
    first = F.row_number().over(Window.partitionBy("book_id", "start_page", F.lower("title")).orderBy("seq"))
    return rows.withColumn("k", first).where("k = 1").drop("k")


def validate(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, number, title, start_page, end_page, confidence, notes): ends trimmed to the next start and the last page; duplicate numbers and
    invalid ranges lose confidence. Trimming asks only for the next start, so one look ahead is exact."""
    w = Window.partitionBy("book_id").orderBy("start_page", "number", "title")
    rows = chapters.join(books.groupBy("book_id").agg(F.max("page_count").alias("page_count")), "book_id")
    end = F.least("end_page", F.coalesce("page_count", "end_page"))
    following = F.lead("start_page").over(w)
    trim = (end >= following) & (following > F.col("start_page"))
    rows = rows.withColumn("trimmed", F.coalesce(trim, F.lit(False))).withColumn("end", F.when(trim, following - 1).otherwise(end))
    rows = rows.withColumn("twice", F.count("*").over(Window.partitionBy("book_id", "number")) > 1).withColumn("bad", F.col("end") < F.col("start_page"))
    confidence = F.least("confidence", F.when(F.col("twice"), 0.4), F.when(F.col("bad"), 0.3))
    notes = F.array_compact(F.array(F.when(F.col("trimmed"), "end page trimmed to next chapter start"), F.when(F.col("twice"), "duplicate chapter number"), F.when(F.col("bad"), "invalid page range")))
    return rows.select("book_id", "number", "title", "start_page", F.col("end").alias("end_page"), confidence.alias("confidence"), notes.alias("notes"))


def from_headings(page_lines: DataFrame, books: DataFrame, height: float = 800.0) -> DataFrame:
    """(book_id, number, title, start_page, end_page, mid_page, confidence): chapters that begin with 'Chapter N' in large type, one a page. A
    chapter that begins in the middle of a page shares it with the one before."""
    form = r"(?i)^[\t-\r ]*(?:chapter|ch\.?)[\t-\r ]+([0-9]{1,4})(?:[^0-9A-Za-z_]|$)[\t-\r .:\-–—]*(.*)$"
    blocks = blocks_of(page_lines).join(body_size(page_lines), "book_id")
    line = F.regexp_replace("text", r"[\t-\r ]+", " ")
    found = blocks.where(line.rlike(form) & (F.col("size") >= F.col("body") * 1.3))
    first = F.row_number().over(Window.partitionBy("book_id", "page").orderBy("y0", "block_seq"))
    found = found.withColumn("k", first).where("k = 1").select("book_id", "page", F.regexp_extract(line, form, 1).cast("int").alias("number"), F.btrim(F.regexp_extract(line, form, 2), F.lit(" .:-–—")).alias("title"), (F.col("y0") > height * 0.25).alias("mid_page"), line.alias("full"))
    w = Window.partitionBy("book_id").orderBy("page")
    following = F.when(F.lead("mid_page").over(w), F.lead("page").over(w)).otherwise(F.lead("page").over(w) - 1)
    rows = found.join(books.groupBy("book_id").agg(F.max("page_count").alias("page_count")), "book_id", "left")
    return rows.select(
        "book_id", "number", F.when(F.col("title") == "", F.col("full")).otherwise(F.col("title")).alias("title"), F.col("page").alias("start_page"),
        F.greatest("page", F.coalesce(following, "page_count", "page")).alias("end_page"), "mid_page", F.when(F.col("title") == "", 0.5).otherwise(0.8).alias("confidence"),
    )


def detect(outline: DataFrame, headings: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, source, chapters): how the chapters of each book are found: its outline if it has two or more, else the large headings if they are
    more, else the outline or the whole book. The choice is a join of counts, not a branch of the driver."""
    n = outline.groupBy("book_id").agg(F.count("*").alias("o"))
    m = headings.groupBy("book_id").agg(F.count("*").alias("h"))
    rows = books.select("book_id").distinct().join(n, "book_id", "left").join(m, "book_id", "left").na.fill(0)
    by_headings = (F.col("o") < 2) & (F.col("h") > F.col("o"))
    source = F.when(by_headings, "heading-pattern").when(F.col("o") > 0, "outline").otherwise("manual")
    return rows.select("book_id", source.alias("source"), F.when(by_headings, F.col("h")).when(F.col("o") > 0, F.col("o")).otherwise(1).cast("long").alias("chapters"))


def pages_of(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, number, page): a page may belong to two chapters. The book is the key of the range join."""
    c, p = chapters.select("book_id", "number", "start_page", "end_page"), pages.select("book_id", "page").distinct()
    return p.join(c, (p.book_id == c.book_id) & p.page.between(c.start_page, c.end_page)).select(p.book_id, "number", "page")


def inspect(books: DataFrame, page_lines: DataFrame) -> DataFrame:
    """(book_id, title, edition_no, native_share, pages): title or slug, the edition named on the first three pages, and the share of pages up to the
    30th with more than 40 characters."""
    pages = page_lines.where("text is not null and page <= 30").select("book_id", "page", "block_seq", "line_no", "text").distinct()
    share = pages.groupBy("book_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("n")).groupBy("book_id").agg(F.round(F.avg(F.when(F.col("n") > 40, 1.0).otherwise(0.0)), 6).alias("native_share"))
    named = F.regexp_extract("text", r"(?i)([0-9]{1,2})(?:st|nd|rd|th) edition", 1)
    edition = pages.where((F.col("page") <= 3) & (named != "")).groupBy("book_id").agg(F.min_by(named, F.struct("page", "block_seq", "line_no")).alias("edition_no"))
    seen = page_lines.groupBy("book_id").agg(F.count_distinct("page").alias("pages"))
    return books.select("book_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "slug").alias("title")).join(share, "book_id", "left").join(edition, "book_id", "left").join(seen, "book_id", "left").select("book_id", "title", "edition_no", "native_share", "pages")
