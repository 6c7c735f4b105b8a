"""The pass over a chapter's blocks: two chapters that share a page."""

from pyspark.sql import functions as F

from foliospark.operators import assemble as A
from foliospark.plans.assemble import _CASES, _end


def blocks(spark, rows):
    lines = spark.createDataFrame([("b", p, i + 1, 1, t, 54.0, y, 300.0, _end(i), s, b, it) for i, (p, y, t, s, b, it) in enumerate(rows)], "book_id STRING, page INT, block_seq INT, line_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE, bold BOOLEAN, italic BOOLEAN")
    chapters = spark.createDataFrame([("b", 10, "Shared pages", 1, 2), ("b", 11, "The next one", 2, 2)], "book_id STRING, number INT, title STRING, start_page INT, end_page INT")
    boxes = spark.createDataFrame([("b", 1, 1, 50.0, 299.0, 310.0, 331.0)], "book_id STRING, page INT, box_no INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    return A.chapter_blocks(lines, chapters, boxes)


def test_two_chapters_on_one_page(spark):
    df = blocks(spark, _CASES)
    kinds = A.classified(df)
    got = {(r.chapter, r.block_seq): r.kind for r in kinds.collect()}
    ten = ["title", "byline", "body", "caption", "caption", "caption", "body", "callout", "callout", "callout", "heading", "reference", "reference", "heading", "body", "footnote", "body", "after", "after"]
    # The block behind the callout's box goes on with it too, as it held nothing but its name.
    assert [got[10, i] for i in range(1, 20)] == ten
    assert [got[11, i] for i in range(17, 20)] == ["before", "title", "body"]
    texts = {(r.chapter, r.pos): r.text for r in A.merged(df, kinds).collect()}
    assert texts[10, 4] == "Figure 10.1 A long caption that goes on and ends here." and texts[10, 8].startswith("KEY POINTS\nThe one point of it")
    issues = {(r.chapter, r.kind): (r.page, r.n) for r in A.boundary_issues(kinds).collect()}
    assert issues == {(10, "after"): (2, 2), (11, "before"): (2, 1)}


def test_titles_by_their_words_and_no_title_at_all(spark):
    rows = [(1, 60.0, "SHARED  PAGES", 20.0, True, False), (1, 120.0, "Text of the chapter, long enough for the type", 10.0, False, False), (2, 60.0, "see chapter 11 in the text", 10.0, False, False)]
    got = {(r.chapter, r.block_seq): r.kind for r in A.classified(blocks(spark, rows)).collect()}
    assert got == {(10, 1): "title", (10, 2): "body", (10, 3): "body", (11, 3): "body"}
    assert A.classified(blocks(spark, rows).limit(0)).where(F.lit(True)).count() == 0
