"""Structure of a chapter: heading paths, section ids, list items, paragraphs, callouts, captions, footnotes, references, cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import slug
from foliospark.operators.layout import BULLET, CAPTION, LETTERED, NUMBERED, PAGE, blocks_of
from foliospark.operators.lines import unique_lines
from foliospark.operators.quality import CHAPTER, chapter_of

# Ends of sentences; names of callouts; headings of reference lists; form of cross-references; blanks other than the plain ones, as characters,
# entities or a tie.
TERMINAL = r"[.!?:;)\]\"'”’]$"
CALLOUT = r"(?i)^[\t-\r ]*(KEY POINTS?|KEY CONCEPTS?|CLINICAL PEARLS?|PEARLS?|IMPORTANT|CONTROVERSIES|SUMMARY|WARNING|CAUTION|NOTE|BOX [0-9][0-9.]*[^\n]{0,60})[\t-\r ]*:?[\t-\r ]*$"
REFERENCE_HEAD = r"(?i)^[\t-\r ]*(references?|bibliography|suggested readings?|further reading)[\t-\r ]*$"
REFERENCE_ITEM = r"^[\t-\r ]*(?:\[([0-9]{1,4})\]|([0-9]{1,4})[.)])[\t-\r ]+([^\t-\r ].*)$"
CROSS_REFERENCE = r"(?:^|[^A-Za-z0-9_])((Chapter|Chap\.|Table|Fig\.|Figure)[\t-\r ]+([0-9]{1,4})(?:\.([0-9]{1,3}))?)"
BLANK = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}~]|&(?:nbsp|ensp|emsp|thinsp|#0*160|#[xX]0*[aA]0);"


def ordered_items(out_items: DataFrame) -> DataFrame:
    """The assembled items, repeated rows once; partitioned by chapter, as all that follows needs it."""
    rows = out_items.select("book_id", "chapter", "ord", "kind", "md", "page", "x0", "y0", "x1", "y1", "block_id", "raw", "cleaned", "confidence", "level", "section_id")
    return rows.repartition(*CHAPTER).distinct()


def by_ord() -> Window:
    return Window.partitionBy(*CHAPTER).orderBy("ord")


def with_paths(items: DataFrame) -> DataFrame:
    """``items`` with ``path``: the headings above each item. A heading of a level counts until one of a lesser level comes."""
    title = F.regexp_extract("md", r"^#{1,6} ([^\n]*)", 1)
    rows = items.withColumn("h", F.when((F.col("kind") == "heading") & (F.col("level") > 0), F.col("level"))).withColumn("t", title)
    upto = by_ord().rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for level in range(1, 7):
        own = F.last(F.when(F.col("h") == level, F.struct("ord", "t")), ignorenulls=True).over(upto)
        lesser = F.max(F.when(F.col("h") < level, F.col("ord"))).over(upto)
        parts.append(F.when(own.isNotNull() & (lesser.isNull() | (own["ord"] > lesser)), own["t"]))
    return rows.select(*(F.col(c) for c in items.columns), F.array_compact(F.array(*parts)).alias("path"))


def heading_paths(items: DataFrame) -> DataFrame:
    return with_paths(items).select(*CHAPTER, "ord", "path")


def section_ids(heads: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, section_id): ids of book, chapter and the last two headings of the path; repeated ones are numbered."""
    base = F.concat(F.col("slug"), F.lit("-ch"), F.col("chapter"), F.lit("-"), slug(F.array_join(F.slice("path", F.greatest(F.size("path") - 1, F.lit(1)), 2), "-"), 70))
    rows = heads.join(books.groupBy("book_id").agg(F.min("slug").alias("slug")), "book_id").withColumn("base", base)
    n = F.row_number().over(Window.partitionBy(*CHAPTER, "base").orderBy("ord"))
    return rows.select(*CHAPTER, "ord", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n)).alias("section_id"))


def list_groups(page_lines: DataFrame) -> DataFrame:
    """(book_id, page, block_seq, group_no, kind, marker, indent, first_line, n_lines): the items and paragraphs of each block. A group begins at a
    list marker, after a gap of more than 0.6 of the type size, or at an indented line behind a full stop."""
    w = Window.partitionBy(*PAGE, "block_seq").orderBy("line_no")
    rows = unique_lines(page_lines).withColumn("left", F.min("x0").over(Window.partitionBy(*PAGE, "block_seq")))
    t = F.col("text")
    item = t.rlike(BULLET) | t.rlike(NUMBERED) | t.rlike(LETTERED)
    before, px, py = F.rtrim(F.lag("text").over(w)), F.lag("x0").over(w), F.lag("y1").over(w)
    indented = (F.col("x0") - F.col("left") > 6) & (px - F.col("left") < 3) & before.rlike(r"\.$")
    breaks = (F.col("y0") - py > 0.6 * F.col("size")) | indented
    rows = rows.withColumn("item", item).withColumn("new", F.when(px.isNull() | item | breaks, 1).otherwise(0))
    rows = rows.withColumn("group_no", F.sum("new").over(w))
    marker = F.when(t.rlike(NUMBERED), F.concat(F.regexp_extract("text", r"^[\t-\r ]*([0-9]{1,2})[.)]", 1), F.lit("."))).when(item, "-")
    indent = F.greatest(F.bround((F.col("x0") - F.col("left")) / 14), F.lit(0)).cast("int")
    first = F.min_by(F.struct(F.when(F.col("item"), "item").otherwise("para").alias("kind"), marker.alias("marker"), F.when(F.col("item"), indent).alias("indent")), "line_no")
    return rows.groupBy(*PAGE, "block_seq", "group_no").agg(first.alias("f"), F.min("line_no").alias("first_line"), F.count("*").alias("n_lines")).select(*PAGE, "block_seq", "group_no", "f.kind", "f.marker", "f.indent", "first_line", "n_lines")


def paragraph_merge(items: DataFrame) -> DataFrame:
    """(book_id, chapter, first_ord, n, ords): paragraphs that go on in the next item: the one before ends no sentence, the next begins in lower case,
    neither has more than one line. The end of a merged paragraph is the end of its last part, so neighbours decide."""
    w = by_ord()
    md = F.col("md")
    goes_on = (
        (F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph") & md.rlike("^[a-zà-öø-ÿ]") & ~md.contains("\n") & ~F.lag("md").over(w).contains("\n") & ~F.rtrim(F.lag("md").over(w)).rlike(TERMINAL)
    )
    rows = items.withColumn("island", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    merged = rows.groupBy(*CHAPTER, "island").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"), F.array_sort(F.collect_list("ord")).alias("ords"))
    return merged.where("n > 1").drop("island")


def callouts(page_lines: DataFrame) -> DataFrame:
    """(book_id, page, block_seq, label, open): blocks that begin with the name of a callout, bold or in capitals; open: nothing else is in them."""
    rows = unique_lines(page_lines)
    first = rows.groupBy(*PAGE, "block_seq").agg(F.min_by(F.struct("text", "bold"), "line_no").alias("f"), F.count("*").alias("n_lines"))
    t = F.col("f.text")
    named = t.rlike(CALLOUT) & (F.col("f.bold") | ((F.upper(t) == t) & (F.lower(t) != t)))
    return first.where(named).select(*PAGE, "block_seq", F.upper(F.trim(F.regexp_extract(t, CALLOUT, 1))).alias("label"), (F.col("n_lines") == 1).alias("open"))


def captions(page_lines: DataFrame) -> DataFrame:
    """(book_id, page, block_seq, what, chapter, no, continued): caption blocks, and whether the next block goes on with it: short, not bold, less than
    6 points below, behind a caption without an end."""
    rows = blocks_of(page_lines)
    w = Window.partitionBy(*PAGE).orderBy("block_seq")
    gap = F.lead("y0").over(w) - F.col("y1")
    continued = (F.lead("n_lines").over(w) <= 2) & ~F.lead("all_bold").over(w) & (gap >= 0) & (gap < 6) & ~F.rtrim("text").rlike(r"[.)]$")
    rows = rows.withColumn("continued", F.coalesce(continued, F.lit(False)))
    no = F.regexp_extract("text", CAPTION, 3)
    return rows.where(F.col("text").rlike(CAPTION)).select(*PAGE, "block_seq", F.regexp_extract("text", CAPTION, 1).alias("what"), F.regexp_extract("text", CAPTION, 2).cast("int").alias("chapter"), F.when(no != "", no.cast("int")).alias("no"), "continued")


def footnotes(page_lines: DataFrame, body: DataFrame, height: float = 800.0, least_y: float = 0.72, small: float = 0.88) -> DataFrame:
    """(book_id, page, block_seq, label): blocks in small type low on a page that begin with a number or a sign."""
    sign = r"^[\t-\r ]*([0-9]{1,2}|[*†‡§])[\t-\r ]*[^\t-\r ]"
    rows = blocks_of(page_lines).join(body, "book_id").where((F.col("size") < F.col("body") * small) & (F.col("y0") > height * least_y) & F.col("text").rlike(sign))
    mark = F.regexp_extract("text", sign, 1)
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_seq"))
    return rows.select(*PAGE, "block_seq", F.when(mark.rlike("^[0-9]"), F.concat(F.lit("p"), "page", F.lit("n"), mark)).otherwise(F.concat(F.lit("p"), "page", F.lit("s"), n)).alias("label"))


def link_footnotes(items: DataFrame, notes: DataFrame) -> DataFrame:
    """``items`` with ``linked``: the first raised number of each footnote of the page as a link to it. Labels of a page are folded over the text."""
    labels = notes.withColumn("n", F.regexp_extract("label", "n([0-9]+)$", 1)).where("n <> ''").groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.struct("n", "label"))).alias("notes"))
    rows = items.join(labels, PAGE, "left")

    def link(text: Column, note: Column) -> Column:
        mark = F.concat(F.lit("<sup>"), note["n"], F.lit("</sup>"))
        at = F.expr("1") * F.call_function("instr", text, mark)
        return F.when(at == 0, text).otherwise(F.concat(F.call_function("left", text, at - 1), F.lit("[^"), note["label"], F.lit("]"), F.call_function("substring", text, at + F.length(mark))))

    return rows.withColumn("linked", F.aggregate(F.coalesce("notes", F.array().cast("array<struct<n:string,label:string>>")), F.col("md"), link)).drop("notes")


def reference_entries(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter, block_id, entry, no, text): entries of the reference lists; lines without a number go on with the entry before."""
    rows = blocks.where("block_type = 'reference' and raw_text is not null").select("book_id", chapter_of(F.col("block_id")).alias("chapter"), "block_id", "raw_text").distinct()
    lines = rows.select("book_id", "chapter", "block_id", F.posexplode(F.split("raw_text", "\n")).alias("pos", "line"))
    begins = F.col("line").rlike(REFERENCE_ITEM)
    lines = lines.withColumn("begins", begins).withColumn("entry", F.sum(begins.cast("int")).over(Window.partitionBy("book_id", "block_id").orderBy("pos")))
    no = F.coalesce(*(F.nullif(F.regexp_extract("line", REFERENCE_ITEM, i), F.lit("")) for i in (1, 2))).cast("int")
    body = F.when(F.col("begins"), F.regexp_extract("line", REFERENCE_ITEM, 3)).otherwise(F.trim("line"))
    parts = F.array_sort(F.collect_list(F.struct("pos", body.alias("t"))))
    return lines.groupBy("book_id", "chapter", "block_id", "entry").agg(F.max(F.when(F.col("begins"), no)).alias("no"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def cross_references(items: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, page, text, kind, target_chapter, target_no): chapters, tables and figures that the running text names."""
    rows = items.where("kind in ('paragraph', 'list', 'callout', 'caption') and md is not null")
    groups = [F.regexp_extract_all("md", F.lit(CROSS_REFERENCE), F.lit(i)) for i in (1, 2, 3, 4)]
    found = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("text", "kind", "target_chapter", "target_no"))))
    rows = rows.select(*CHAPTER, "ord", "page", F.explode(found).alias("r"))
    no = F.nullif(F.col("r.target_no"), F.lit(""))
    return rows.select(*CHAPTER, "ord", "page", "r.text", "r.kind", F.col("r.target_chapter").cast("int").alias("target_chapter"), no.cast("int").alias("target_no"))


def resolve(refs: DataFrame, converted: DataFrame) -> DataFrame:
    """``refs`` with ``link``: the target in a converted chapter (book_id, chapter, file), null if it isn't converted. Tables and figures of the item's
    own chapter need no link and are left out."""
    own = (F.col("target_chapter") == F.col("chapter")) & ~F.col("kind").startswith("Chap")
    target = converted.select(F.col("book_id").alias("__b"), F.col("chapter").alias("__c"), "file")
    what = F.when(F.col("kind") == "Table", "table").when(F.col("kind").startswith("Fig"), "figure")
    anchor = F.when(what.isNotNull() & F.col("target_no").isNotNull(), F.concat(F.lit("#"), what, F.lit("-"), "target_chapter", F.lit("-"), "target_no")).otherwise(F.lit(""))
    not_self = ~((F.col("target_chapter") == F.col("chapter")) & F.col("kind").startswith("Chap"))
    rows = refs.where(~own).join(target, (F.col("book_id") == F.col("__b")) & (F.col("target_chapter") == F.col("__c")) & not_self, "left")
    return rows.withColumn("link", F.when(F.col("file").isNotNull(), F.concat(F.lit("["), "text", F.lit("]("), "file", anchor, F.lit(")")))).drop("__b", "__c", "file")


def relinked(refs: DataFrame, written: DataFrame, added: DataFrame) -> DataFrame:
    """``refs`` to other chapters that were added after the item was written, with the ``file`` of the chapter. ``written``: (book_id, chapter, ord, written_at);
    ``added``: (book_id, target_chapter, added_at), the first time each chapter came."""
    rows = refs.where("chapter <> target_chapter").join(written, [*CHAPTER, "ord"]).join(added, ["book_id", "target_chapter"]).where("added_at > written_at")
    return rows.withColumn("file", F.format_string("ch_%03d.md", "target_chapter"))


#: Places of the captions that a figure and a table may take, the nearest first: figures look three items on, then two back, tables to their
#: neighbours.
NEAR = {"figure": (1, 2, 3, -1, -2), "table": (-1, 1)}


def match_captions(items: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, kind, caption_ord): figures and tables with their captions. Each takes the nearest free one, figures on their own page
    only; a caption is taken once, so earlier items choose first. The choices are a fold over the figures and tables of a chapter."""
    rows = items.select(*CHAPTER, "ord", "kind", "md", "page")
    w = by_ord()

    def candidate(kind: str, k: int) -> Column:
        at = {c: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w) for c in ("ord", "kind", "md", "page")}
        fits = (at["kind"] == "caption") & at["md"].startswith("Fig" if kind == "figure" else "Table")
        return F.when(fits & (at["page"] == F.col("page")) if kind == "figure" else fits, at["ord"])

    choices = F.when(F.col("kind") == "figure", F.array(*(candidate("figure", k) for k in NEAR["figure"]))).when(F.col("kind") == "table", F.array(*(candidate("table", k) for k in NEAR["table"])))
    rows = rows.withColumn("choices", F.array_compact(choices)).where("kind in ('figure', 'table')")
    lists = rows.groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "choices"))).alias("l"))

    def step(taken: Column, x: Column) -> Column:
        """``taken`` has a caption, or -1, for each item so far."""
        return F.concat(taken, F.array(F.coalesce(F.get(F.array_except(x["choices"], taken), F.lit(0)), F.lit(-1))))

    lists = lists.withColumn("taken", F.aggregate("l", F.array().cast("array<int>"), step))
    pairs = lists.select(*CHAPTER, F.explode(F.arrays_zip("l", "taken")).alias("x"))
    return pairs.select(*CHAPTER, "x.l.ord", "x.l.kind", F.nullif(F.col("x.taken"), F.lit(-1)).alias("caption_ord"))


def figure_numbers(items: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, kind, caption_ord, number, file): the number of each figure and table from its caption, else from its place among those of
    its kind in the chapter; and the name of its file, with a suffix where a name is taken. A blank before the number of a figure may be of any kind; a
    table's caption is read as its SQL reads it, with plain blanks only."""
    pairs = match_captions(items)
    md = items.select(*CHAPTER, F.col("ord").alias("caption_ord"), "md")
    rows = pairs.join(md, [*CHAPTER, "caption_ord"], "left")
    text = F.when(F.col("kind") == "figure", F.regexp_replace("md", BLANK, " ")).otherwise(F.col("md"))
    main, no = (F.nullif(F.regexp_extract(text, CAPTION, i), F.lit("")).cast("int") for i in (2, 3))
    of_caption = F.concat(main, F.when(no.isNotNull(), F.format_string("_%02d", no)).otherwise(""))
    place = F.row_number().over(Window.partitionBy(*CHAPTER, "kind").orderBy("ord"))
    numbered = main.isNotNull() & ((F.col("kind") == "figure") | no.isNotNull())
    rows = rows.withColumn("number", F.when(numbered, of_caption).otherwise(F.format_string("%d_%02d", "chapter", place)))
    n = F.row_number().over(Window.partitionBy(*CHAPTER, "kind", "number").orderBy("ord"))
    file = F.concat("kind", F.lit("_"), "number", F.when(n > 1, F.concat(F.lit("_"), n)).otherwise(""), F.when(F.col("kind") == "figure", ".png").otherwise(".md"))
    return rows.select(*CHAPTER, "ord", "kind", "caption_ord", "number", file.alias("file"))


def caption_issues(items: DataFrame) -> DataFrame:
    """(book_id, chapter, severity, code, page, n): figures without a caption, figure captions without a figure, and chapters with more captions than
    figures or tables."""
    pairs = match_captions(items)
    pages = items.select(*CHAPTER, "ord", "page")
    caps = items.where("kind = 'caption'").select(*CHAPTER, "ord", "page", F.when(F.col("md").startswith("Fig"), "figure").when(F.col("md").startswith("Table"), "table").alias("what"))
    taken = pairs.where("caption_ord is not null").select(*CHAPTER, F.col("caption_ord").alias("ord"))
    lone = pairs.where("kind = 'figure' and caption_ord is null").join(pages, [*CHAPTER, "ord"]).select(*CHAPTER, F.lit("MEDIUM").alias("severity"), F.lit("FIGURE_NO_CAPTION").alias("code"), "page", F.lit(1).cast("long").alias("n"))
    loose = caps.where("what = 'figure'").join(taken, [*CHAPTER, "ord"], "left_anti").select(*CHAPTER, F.lit("MEDIUM"), F.lit("CAPTION_NO_FIGURE"), "page", F.lit(1).cast("long"))
    had = pairs.groupBy(*CHAPTER, F.col("kind").alias("what")).agg(F.count("*").alias("had"))
    want = caps.where("what is not null").groupBy(*CHAPTER, "what").agg(F.count("*").alias("want")).join(had, [*CHAPTER, "what"], "left").withColumn("n", F.col("want") - F.coalesce("had", F.lit(0))).where("n > 0")
    counts = want.select(*CHAPTER, F.lit("HIGH"), F.concat(F.upper("what"), F.lit("_COUNT")), F.lit(None).cast("int"), "n")
    return lone.union(loose).union(counts)


def equal_boxes(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, block_id): table items and the table blocks with the same box on their page."""
    box = ["x0", "y0", "x1", "y1"]
    b = blocks.where("block_type = 'table'").select("book_id", "page", *box, "block_id").distinct()
    return items.where("kind = 'table'").select(*CHAPTER, "ord", "page", *box).join(b, ["book_id", "page", *box]).select(*CHAPTER, "ord", "block_id")
