"""The pass over the blocks of a chapter in reading order: what belongs to the chapter, and what each block is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.layout import CAPTION, PAGE, blocks_of, body_size, first_box, heading_styles, reading_order
from foliospark.operators.lines import unique_lines
from foliospark.operators.quality import CHAPTER
from foliospark.operators.structure import CALLOUT, REFERENCE_HEAD

# Type of a chapter's title over that of the text; least letters of a title that stands in another; longest byline; type and height of
# footnotes; gap and number of the blocks that go on with a caption.
TITLE_SIZE, TITLE_LETTERS, BYLINE_CHARS, BYLINE_LINES = 1.3, 4, 120, 2
NOTE_SIZE, NOTE_HEIGHT, NOTE_SIGN = 0.88, 0.72, r"^[\t-\r ]*(?:[0-9]{1,2}|[*†‡§])[\t-\r ]*[^\t-\r ]"
CAPTION_GAP, CAPTION_MORE = 6.0, 2
NAMED = r"(?i)^[\t-\r ]*chapter[\t-\r ]+([0-9]{1,9})(?:[^0-9A-Za-z_]|$)"


def chapter_blocks(page_lines: DataFrame, chapters: DataFrame, shaded: DataFrame) -> DataFrame:
    """The blocks of the pages of each chapter (book_id, number, title, start_page, end_page) in reading order, with what the pass asks of them. A page may
    belong to two chapters. ``shaded``: boxes (book_id, page, box_no, x0, y0, x1, y1)."""
    blocks = blocks_of(page_lines)
    first = unique_lines(page_lines).groupBy(*PAGE, "block_seq").agg(F.min_by(F.struct("text", "bold"), "line_no").alias("f")).select(*PAGE, "block_seq", F.btrim("f.text", F.lit(" \t\n")).alias("first"), F.col("f.bold").alias("first_bold"))
    styles = heading_styles(page_lines).select(*PAGE, "block_seq", F.struct("size", "caps").alias("style"))
    order = reading_order(blocks).select(*PAGE, "block_seq", F.col("pos").alias("in_page"))
    boxes = first_box(blocks, shaded, ["block_seq"])
    rows = blocks.join(first, [*PAGE, "block_seq"]).join(order, [*PAGE, "block_seq"]).join(boxes, [*PAGE, "block_seq"], "left").join(styles, [*PAGE, "block_seq"], "left").join(body_size(page_lines), "book_id")
    c = chapters.select("book_id", F.col("number").alias("chapter"), "title", "start_page", "end_page")
    rows = rows.join(c, (rows.book_id == c.book_id) & rows.page.between(c.start_page, c.end_page)).drop(c.book_id)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("page", "in_page")))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def bounded(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``part``: 'title' of the chapter, 'before' it, 'after' the title of another chapter in large type, or 'in'; and ``level``, the rank of
    its style among the heading styles of the chapter, whose titles don't count. A title stands on the first page: 'Chapter' and the number, or the
    words of the title in large type."""
    large = F.col("size") >= TITLE_SIZE * F.col("body")
    named = F.nullif(F.regexp_extract(F.regexp_replace("text", "\n", " "), NAMED, 1), F.lit("")).cast("int")
    words, title = _letters(F.col("text")), _letters(F.coalesce("title", F.lit("")))
    alike = (title != "") & (F.length(words) > TITLE_LETTERS) & (F.contains(title, words) | F.contains(words, title)) & large
    rows = blocks.withColumn("is_title", (F.col("page") == F.col("start_page")) & (F.coalesce(named == F.col("chapter"), F.lit(False)) | alike))
    rows = rows.withColumn("foreign", ~F.col("is_title") & F.coalesce(named != F.col("chapter"), F.lit(False)) & large & (F.col("pos") > 1))
    every = Window.partitionBy(*CHAPTER)
    rows = rows.withColumn("stop", F.min(F.when(F.col("foreign"), F.col("pos"))).over(every))
    rows = rows.withColumn("begin", F.min(F.when(F.col("is_title") & (F.col("stop").isNull() | (F.col("pos") < F.col("stop"))), F.col("pos"))).over(every))
    part = F.when(F.col("pos") >= F.col("stop"), "after").when(F.col("pos") < F.col("begin"), "before").when(F.col("is_title"), "title").otherwise("in")
    rows = rows.withColumn("part", part).withColumn("style", F.when(F.col("part").isin("in", "before"), F.col("style")))
    rank = F.dense_rank().over(Window.partitionBy(*CHAPTER).orderBy(F.col("style").isNull(), F.desc("style")))
    return rows.withColumn("level", F.when(F.col("style").isNotNull(), F.least(F.lit(5), rank + 1))).drop("is_title", "foreign", "stop", "begin", "style")


def classified(blocks: DataFrame, height: float = 800.0) -> DataFrame:
    """(book_id, chapter, pos, page, block_seq, kind, head): each block of a chapter with its kind, in order, and the block it goes on with (itself, if none).

    Kinds: title, byline (in italics right under the title), footnote, caption, callout, heading, reference (below a heading of references, up to the next
    heading of that level), body; and before, after for what isn't the chapter's. Short blocks right under an open caption go on with it, two at most;
    blocks in the box of a callout go on with it, and one block behind a callout of nothing but its name. A fold over the blocks of a chapter, since
    what a block is depends on what the one before was taken for."""
    rows = bounded(blocks)
    short = F.col("n_lines") <= 2
    first, text = F.col("first"), F.col("text")
    capitals = (F.upper(first) == first) & (F.lower(first) != first)
    facts = F.struct(
        "pos", "page", "y0", "y1", "block_seq", F.coalesce("box", F.lit(-1)).cast("int").alias("box"), F.coalesce("level", F.lit(0)).alias("level"),
        (F.col("part") == "title").alias("title"), (short & F.col("all_italic") & (F.length(text) < BYLINE_CHARS)).alias("italic"),
        ((F.col("size") < NOTE_SIZE * F.col("body")) & (F.col("y0") > NOTE_HEIGHT * height) & first.rlike(NOTE_SIGN)).alias("note"), first.rlike(CAPTION).alias("caption"),
        (short & ~F.col("first_bold")).alias("plain"), F.rtrim(text).rlike(r"[.)]$").alias("ends"), (first.rlike(CALLOUT) & (F.col("first_bold") | capitals | F.col("box").isNotNull())).alias("callout"),
        (F.col("n_lines") == 1).alias("alone"), F.regexp_replace(text, "\n", " ").rlike(REFERENCE_HEAD).alias("references"),
    )
    lists = rows.where("part in ('in', 'title')").groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(facts)).alias("l"))
    out = "array<struct<pos:int,page:int,block_seq:int,kind:string,head:int>>"
    none = F.struct(
        F.lit("").alias("last"), F.lit(0).alias("page"), F.lit(-1).alias("box"), F.lit(False).alias("open"), F.lit(0.0).alias("y1"), F.lit(False).alias("ends"), F.lit(0).alias("more"), F.lit(0).alias("head"),
        F.lit(False).alias("refs"), F.lit(False).alias("titled"), F.lit(True).alias("only_titles"), F.array().cast(out).alias("out"),
    )

    def kind_of(a: Column, x: Column) -> Column:
        here = a["page"] == x["page"]
        gap = x["y0"] - a["y1"]
        return (
            F.when(x["title"], "title").when(a["titled"] & a["only_titles"] & x["italic"], "byline").when(x["note"], "footnote").when(x["caption"], "caption")
            .when((a["last"] == "caption") & here & x["plain"] & (gap >= 0) & (gap < CAPTION_GAP) & ~a["ends"] & (a["more"] < CAPTION_MORE), "+caption").when(x["callout"], "callout")
            .when((a["last"] == "callout") & here & (x["box"] >= 0) & (a["box"] == x["box"]), "+box").when((a["last"] == "callout") & here & a["open"], "+open")
            .when(x["level"] > 0, "heading").when(a["refs"], "reference").otherwise("body")
        )

    def step(a: Column, x: Column) -> Column:
        def state(k: Column) -> Column:
            goes_on = k.startswith("+")
            head = F.when(goes_on, a["head"]).otherwise(x["pos"])
            refs = F.when((k == "heading") & x["references"], True).when((k == "heading") & (x["level"] <= 2), False).otherwise(a["refs"])
            shown = F.when(k == "+caption", "caption").when(goes_on, "callout").otherwise(k)
            row = F.struct(x["pos"].alias("pos"), x["page"].alias("page"), x["block_seq"].alias("block_seq"), shown.alias("kind"), head.alias("head"))
            return F.struct(
                shown.alias("last"), F.when(goes_on, a["page"]).otherwise(x["page"]).alias("page"), F.when(goes_on, a["box"]).otherwise(x["box"]).alias("box"),
                F.when(k == "callout", x["alone"]).when(k == "+box", a["open"]).otherwise(False).alias("open"), F.when(goes_on, a["y1"]).otherwise(x["y1"]).alias("y1"), x["ends"].alias("ends"),
                F.when(k == "+caption", a["more"] + 1).otherwise(0).alias("more"), head.alias("head"), refs.alias("refs"), (a["titled"] | (k == "title")).alias("titled"), (a["only_titles"] & (k == "title")).alias("only_titles"), F.concat(a["out"], F.array(row)).alias("out"),
            )

        # The kind is worked out once and bound, as every part of the state asks for it.
        return F.element_at(F.transform(F.array(kind_of(a, x)), state), 1)

    kept = lists.select(*CHAPTER, F.explode(F.aggregate("l", none, step, lambda a: a["out"])).alias("x")).select(*CHAPTER, "x.*")
    dropped = rows.where("part in ('before', 'after')").select(*CHAPTER, "pos", "page", "block_seq", F.col("part").alias("kind"), F.col("pos").alias("head"))
    return kept.union(dropped)


def merged(blocks: DataFrame, kinds: DataFrame) -> DataFrame:
    """(book_id, chapter, pos, kind, n, text): the items of a chapter; a caption's or callout's text with the blocks that go on with it."""
    rows = kinds.where("kind not in ('before', 'after')").join(blocks.select(*CHAPTER, "pos", "text"), [*CHAPTER, "pos"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    items = rows.groupBy(*CHAPTER, "head").agg(F.max("kind").alias("kind"), F.count("*").alias("n"), F.transform(parts, lambda x: x["text"]).alias("t"))
    text = F.when(F.col("kind") == "caption", F.replace(F.array_join("t", " "), F.lit("\n"), F.lit(" "))).otherwise(F.array_join("t", "\n"))
    return items.select(*CHAPTER, F.col("head").alias("pos"), "kind", "n", text.alias("text"))


def boundary_issues(kinds: DataFrame) -> DataFrame:
    """(book_id, chapter, severity, code, page, n): what was left out of a chapter because it belongs to another: the blocks before its title and after
    the title of the next."""
    rows = kinds.where("kind in ('before', 'after')").groupBy(*CHAPTER, "kind").agg(F.min("page").alias("page"), F.count("*").alias("n"))
    return rows.select(*CHAPTER, F.lit("LOW").alias("severity"), F.lit("CHAPTER_BOUNDARY").alias("code"), "kind", "page", "n")
