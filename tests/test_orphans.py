from datetime import datetime

from foliospark.operators.orphans import found, orphans, report

ITEMS = "book_id STRING, chapter INT, ord INT, kind STRING, md STRING, written_at TIMESTAMP_NTZ, added_at STRING, at STRING"
REFS = "book_id STRING, chapter INT, ref_no INT, text STRING, added_at TIMESTAMP_NTZ, removed_at TIMESTAMP_NTZ"
CHAPTERS = "book_id STRING, number INT, title STRING, added_at TIMESTAMP_NTZ, removed_at TIMESTAMP_NTZ"


def day(n):
    return datetime(2024, 1, n)


def tables(spark, items):
    refs = [("b", 1, 1, "x", day(1), None), ("b", 1, 1, "x", day(1), None), ("b", 1, 2, "x", day(1), day(5)), ("b", 1, 3, "x", day(9), None), ("b", 1, 2, "x", day(8), None), (None, None, None, None, None, None)]
    chapters = [("b", 1, "t", day(1), None), ("b", 2, "t", day(1), day(3)), ("b", 3, None, None, None)]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(refs, REFS), spark.createDataFrame(chapters, CHAPTERS)


def test_found(spark):
    items = [
        ("b", 1, 1, "paragraph", "[1] [2] [3], `[9]`, see [Chapter 1](x/7.md)", day(4), "clash", "clash"),
        ("b", 1, 1, "paragraph", "[1] [2] [3], `[9]`, see [Chapter 1](x/7.md)", day(4), "clash", "clash"),
        ("b", 1, 2, "paragraph", "[1–3] Table 2.1", day(5), None, None),
        ("b", 1, 3, "reference", "[7] name", day(5), None, None),
        ("b", 1, 4, None, None, day(5), None, None),
        ("b", 1, 5, "list", "", day(5), None, None),
        (None, 1, 6, "list", "[8]", day(5), None, None),
        ("b", 1, 7, "list", "[8]", None, None, None),
        ("b", None, 8, "list", "[8] Chapter 9", day(5), None, None),
        ("b", 1, 9, None, "word " * 50000 + "[4]", day(9), None, None),
    ]
    got = {tuple(r) for r in found(*tables(spark, items)).collect()}
    assert got == {("b", 1, 1, "chapter_refs", 3), ("b", 1, 2, "chapter_refs", 2), ("b", 1, 2, "chapter_refs", 3), ("b", 1, 2, "chapters", 2), ("b", None, 8, "chapters", 9), ("b", 1, 9, "chapter_refs", 4)}
    rows = {(r.target_table, r.month): (r.n_refs, r.n_orphans) for r in report(*tables(spark, items)).collect()}
    assert rows[("chapter_refs", "2024-01")] == (7, 4) and rows[("chapters", "2024-01")] == (3, 2)


def test_all_numbers_of_a_wide_range(spark):
    given = tables(spark, [("b", 1, 1, "paragraph", "[1-20000, 7]", day(4), None, None), ("b", 1, 2, "paragraph", "[5–100004]", day(4), None, None)])
    got = [(r.ord, r.target_no) for r in found(*given).collect()]
    # 1 and 2 hold.
    assert len(got) == 19998 + 100000 and set(got) == {(1, n) for n in range(3, 20001)} | {(2, n) for n in range(5, 100005)}
    (row,) = report(*given).collect()
    assert (row.n_refs, row.n_orphans) == (120000, 119998)


def test_empty(spark):
    items, refs, chapters = tables(spark, [])
    assert found(items, refs, chapters).count() == 0 and report(items, refs, chapters).count() == 0
    one = tables(spark, [("b", 1, 1, "list", "[1]", day(5), None, None)])[0]
    assert found(one, refs.limit(0), chapters.limit(0)).count() == 1


def test_ties_of_the_interval(spark):
    refs = spark.createDataFrame([(1, day(1)), (1, day(2)), (1, day(3))], "k INT, at TIMESTAMP_NTZ")
    parents = spark.createDataFrame([(1, day(2), day(3), "x")], "k INT, added_at TIMESTAMP_NTZ, removed_at TIMESTAMP_NTZ, at STRING")
    assert sorted(r.at for r in orphans(refs, parents, ["k"]).collect()) == [day(1), day(3)]
