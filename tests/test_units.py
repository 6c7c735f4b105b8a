"""Single operators on literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from foliospark.functions import references as R
from foliospark.functions import tables as T
from foliospark.functions import text as X
from foliospark.operators import assembly as A
from foliospark.operators import layout as Y
from foliospark.operators import lines as L
from foliospark.operators import quality as Q
from foliospark.operators import structure as S
from foliospark.operators import retrieval as V
from foliospark.operators.search import Index, only, stem


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x STRING").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "lines, words, compounds, want",
    [
        (["the pedi-", "atric patient"], {"the", "patient"}, set(), "the pediatric patient"),
        (["a long-", "term plan"], {"long", "term", "plan"}, {"long-term"}, "a long-term plan"),
        (["Smith-", "Jones syndrome"], set(), set(), "Smith-Jones syndrome"),
        (["anti-", "body titres"], {"antibody", "levels"}, set(), "antibody titres"),
        (["in the pedi-", "atric-", "ward now"], {"in", "the", "ward", "now"}, set(), "in the pediatric-ward now"),
        (["", "  a  ", "b"], set(), set(), "a b"),
    ],
)
def test_join_lines(spark, lines, words, compounds, want):
    # In the fifth case the second hyphen is decided on the joined word, which is no fragment of 'ward'.
    words = words | ({"pediatric"} if "atric-" in lines else set())
    blocks = spark.createDataFrame([("b", "1", lines)], "book_id STRING, block STRING, lines ARRAY<STRING>")
    w = spark.createDataFrame([("b", x) for x in words], "book_id STRING, word STRING")
    c = spark.createDataFrame([("b", x) for x in compounds], "book_id STRING, compound STRING")
    assert L.join_blocks(blocks, w, c).first().text == want


def test_open_hyphens(spark):
    blocks = spark.createDataFrame([("b", "1", ["some ab-", "cd text"]), ("b", "2", []), ("b", "3", ["some-", "thing e-", "mail"])], "book_id STRING, block STRING, lines ARRAY<STRING>")
    none = spark.createDataFrame([], "book_id STRING, word STRING")
    got = {r.block: (r.text, r.unsure) for r in L.join_blocks(blocks, none, none.toDF("book_id", "compound")).collect()}
    assert got == {"1": ("some ab-cd text", ["ab-cd"]), "2": ("", []), "3": ("something e-mail", [])}


def test_vocabulary_skips_parts_of_divided_words(spark):
    rows = [("b", 1, 1, 1, "end of pedi-"), ("b", 1, 1, 2, "atric ward"), ("b", 1, 2, 1, "a long-term plan")]
    lines = spark.createDataFrame(rows, "book_id STRING, page INT, block_seq INT, line_no INT, text STRING")
    words = {r.word for r in L.words(lines).collect()}
    assert words == {"end", "of", "ward", "long", "term", "plan"}
    assert [r.compound for r in L.compounds(lines).collect()] == ["long-term"]


def test_margins(spark):
    rows = [("b", p, s, 1, t, 50.0, y, 90.0, y, 8.0, False, False) for p in range(1, 6) for s, t, y in ((1, f"Running  header title {p}", 20.0), (2, "body", 400.0), (3, str(p), 780.0))]
    lines = spark.createDataFrame(rows, "book_id STRING, page INT, block_seq INT, line_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE, bold BOOLEAN, italic BOOLEAN")
    assert {r.margin for r in L.running_margin_lines(lines).collect()} == {"running header title #", "#"}


def test_scalars(spark):
    assert one(spark, "ﬁne​ day", X.normalize_chars) == "fine day"
    assert one(spark, " a \t b ", X.normalize_ws) == "a b"
    assert one(spark, "85\xa0hours\u2009of\u202frest\xad", X.normalize_chars) == "85 hours of rest"
    assert one(spark, "\u2003 a\u3000\u2028", X.normalize_ws) == "a"
    assert one(spark, "A  b\nC", X.fingerprint) == one(spark, "a b c", X.fingerprint) == hashlib.sha256(b"a b c").hexdigest()[:16]
    assert one(spark, "Page 12", X.is_page_number) and not one(spark, "Page 12 of", X.is_page_number)
    assert one(spark, "  ", X.junk_share) is None and one(spark, "ab�\x01", X.junk_share) == 0.5
    assert one(spark, "Ménière & Co.", lambda c: X.slug(X.decompose(c))) == "meniere-co"
    assert one(spark, "!!!", X.slug) == "untitled" and one(spark, None, X.slug) is None
    assert one(spark, "2.50 and 1,000 <b>3</b> [^4] ![5](6) [7](8)", X.number_tokens) == ["2.50", "1000", "3", "7"]
    assert one(spark, "Te cat. Tere Tis", X.restore_lost_h) == "The cat. There This"
    row = spark.createDataFrame([("Chapter 7: The heart",), ("12. Lungs",), ("Skin",)], "t STRING").select(*(c.alias(n) for c, n in zip(X.clean_title(F.col("t")), "ab"))).collect()
    assert [tuple(r) for r in row] == [(7, "The heart"), (12, "Lungs"), (None, "Skin")]


def numbers(spark, text):
    """The cited numbers of a text, in their order."""
    df = spark.createDataFrame([(text,)], "x STRING").select(F.explode(R.cited_ranges(R.prose(F.col("x")))).alias("r")).select("r.lo", "r.hi")
    return [r.no for r in R.explode_range(df, "lo", "hi", "no").collect()]


def test_citations(spark):
    assert numbers(spark, "[1], [2–3] and [5, 7-8] but `x[9]`, $a[10]$, [A] and [x](y[11])") == [1, 2, 3, 5, 7, 8]
    assert numbers(spark, "[9-3] [1-20000]") == [9, 3, *range(1, 20001)]
    assert numbers(spark, "```\n[4]\n``` [5] $$[6]$$ [7](a[8]) text") == [5, 7]
    assert numbers(spark, None) == [] and numbers(spark, "no brackets") == []
    assert one(spark, "see [Chapter 4](c/09.md), Chap. 5, Table 6.1, Fig. 7.2, Figure 8", R.chapter_numbers) == [4, 5, 6, 7]
    assert one(spark, None, R.cited_ranges) is None and one(spark, None, R.chapter_numbers) is None


def test_tables(spark):
    df = spark.createDataFrame([([["a", "b"], ["1|2", None], ["3"]],)], "r ARRAY<ARRAY<STRING>>")
    row = df.select(T.to_pipes(F.col("r")).alias("g"), T.to_html(F.col("r")).alias("h"), T.ragged(F.col("r")).alias("x"), T.empty_ratio(F.col("r")).alias("e")).first()
    assert row.g == "| a | b |\n| --- | --- |\n| 1\\|2 |  |\n| 3 |  |"
    assert row.h == "<table>\n  <tr><th>a</th><th>b</th></tr>\n  <tr><td>1|2</td><td></td></tr>\n  <tr><td>3</td></tr>\n</table>"
    assert row.x and row.e == 0.2


def test_reading_order_two_columns(spark):
    boxes = [(1, 50, 100, 280), (2, 330, 90, 560), (3, 50, 200, 280), (4, 330, 190, 560), (5, 50, 50, 560), (6, 50, 300, 560)]
    df = spark.createDataFrame([("b", 1, s, float(x0), float(y), float(x1), float(y) + 20) for s, x0, y, x1 in boxes], "book_id STRING, page INT, block_seq INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    rows = sorted(Y.reading_order(df).collect(), key=lambda r: r.pos)
    assert [r.block_seq for r in rows] == [5, 1, 3, 2, 4, 6]
    assert [r.col for r in rows] == [0, 1, 1, 2, 2, 0]


def test_heading_repair_and_skips(spark):
    levels = [3, 5, 2, 4, 4, 6]
    heads = spark.createDataFrame([("b", 1, i, 1, lv, "t") for i, lv in enumerate(levels)], "book_id STRING, chapter INT, page INT, block_seq INT, level INT, text STRING")
    assert [r.repaired for r in sorted(Q.heading_repair(heads).collect(), key=lambda r: r.page)] == [2, 3, 2, 3, 4, 5]
    assert [r.level for r in sorted(Q.heading_skips(heads).collect(), key=lambda r: r.page)] == [5, 4, 6]


def test_split_words(spark):
    rows = [("b", 1, "pedi", 1, 0), ("b", 1, "atric", 1, 0), ("b", 1, "pediatric", 0, 1), ("b", 1, "lost", 2, 0)]
    diff = spark.createDataFrame(rows, "book_id STRING, chapter INT, token STRING, n_src LONG, n_out LONG")
    assert tuple(Q.reconcile_split_words(diff).select("freed", "lost").first()) == (2, 2)


def test_inline_marks(spark):
    spans = [("plain ", False, False, False, False), ("bold", True, False, False, False), (" ", False, False, False, False), ("more", True, False, False, False), ("3", False, False, True, False), ("12", False, False, True, False), ("2", False, False, False, True), (" it", False, True, False, False)]
    df = spark.createDataFrame([([{"text": t, "size": 10.0, "bold": b, "italic": i, "sup": p, "sub": u} for t, b, i, p, u in spans],)], "s ARRAY<STRUCT<text STRING, size DOUBLE, bold BOOLEAN, italic BOOLEAN, sup BOOLEAN, sub BOOLEAN>>")
    assert df.select(A.inline_marks(F.col("s")).alias("m")).first().m == "plain **bold more**³<sup>12</sup>₂ *it*"


def test_cross_references(spark):
    item = [("b", 5, 1, "paragraph", "see Chapter 1 and Table 1.2, also Chapter 201. Table 5.3 here.", 3)]
    items = spark.createDataFrame(item, "book_id STRING, chapter INT, ord INT, kind STRING, md STRING, page INT")
    converted = spark.createDataFrame([("b", 1, "ch_001.md")], "book_id STRING, chapter INT, file STRING")
    links = [r.link for r in sorted(S.resolve(S.cross_references(items), converted).collect(), key=lambda r: r.text)]
    assert sorted(x for x in links if x) == ["[Chapter 1](ch_001.md)", "[Table 1.2](ch_001.md#table-1-2)"] and links.count(None) == 1


def test_captions_are_taken_once(spark):
    rows = [("b", 1, 1, "figure", "", 1), ("b", 1, 2, "figure", "", 1), ("b", 1, 3, "caption", "Figure 1.1 x", 1), ("b", 1, 4, "table", "", 1), ("b", 1, 5, "caption", "Table 1.1 y", 1)]
    got = {r.ord: r.caption_ord for r in S.match_captions(spark.createDataFrame(rows, "book_id STRING, chapter INT, ord INT, kind STRING, md STRING, page INT")).collect()}
    assert got == {1: 3, 2: None, 4: 5}


def test_composite_figure(spark):
    rows = [("b", 1, 1, "fragment", "", 100.0, 100.0, 200.0, 150.0, 0.0), ("b", 1, 2, "text", "label", 110.0, 155.0, 150.0, 165.0, 8.0), ("b", 1, 3, "caption", "Fig. 1", 100.0, 200.0, 300.0, 210.0, 9.0), ("b", 1, 4, "text", "far", 100.0, 600.0, 300.0, 610.0, 10.0)]
    df = spark.createDataFrame(rows, "book_id STRING, page INT, seq INT, kind STRING, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE")
    assert [tuple(r) for r in Y.composite_figures(df).collect()] == [("b", 1, 3, 1, ["label"])]


def test_composite_claims(spark):
    """Each fragment and label belongs to the first caption that reaches it; bullets of a label part it; a lone fragment without labels is no figure."""
    rows = [
        ("caption", "Fig. 1", 50.0, 200.0, 250.0, 210.0, 9.0), ("fragment", "", 60.0, 100.0, 160.0, 150.0, 0.0), ("text", "• one\n• two\nmore", 60.0, 155.0, 100.0, 165.0, 8.0), ("text", "plain\nlabel", 120.0, 155.0, 160.0, 165.0, 8.0),
        ("caption", "Fig. 2", 50.0, 400.0, 250.0, 410.0, 9.0), ("fragment", "", 60.0, 300.0, 160.0, 350.0, 0.0), ("fragment", "", 60.0, 355.0, 160.0, 360.0, 0.0), ("fragment", "", 60.0, 365.0, 160.0, 380.0, 0.0),
        ("caption", "Fig. 3", 300.0, 700.0, 500.0, 710.0, 9.0), ("fragment", "", 310.0, 600.0, 400.0, 650.0, 0.0),
    ]
    df = spark.createDataFrame([("b", 1, i, *x) for i, x in enumerate(rows)], "book_id STRING, page INT, seq INT, kind STRING, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE")
    assert sorted(tuple(r)[2:] for r in Y.composite_figures(df).collect()) == [(0, 1, ["one", "two more", "plain label"]), (4, 3, [])]
    assert Y.composite_figures(df.limit(0)).count() == 0


def test_numbers_and_files(spark):
    rows = [
        (1, "figure", "", 1), (2, "caption", "Figure 2.3 a", 1), (3, "figure", "", 1), (4, "caption", "Fig. 2.3 b", 1), (5, "figure", "", 9), (6, "caption", "Table 2.1 c", 9), (7, "table", "", 9), (8, "table", "", 9), (9, "caption", "Table 5", 9), (10, "caption", "Figure 9", 9),
    ]
    items = spark.createDataFrame([("b", 7, *x) for x in rows], "book_id STRING, chapter INT, ord INT, kind STRING, md STRING, page INT")
    got = {r.ord: (r.number, r.file) for r in S.figure_numbers(items).collect()}
    assert got == {1: ("2_03", "figure_2_03.png"), 3: ("2_03", "figure_2_03_2.png"), 5: ("7_03", "figure_7_03.png"), 7: ("2_01", "table_2_01.md"), 8: ("7_02", "table_7_02.md")}
    issues = sorted((r.code, r.page or 0, r.n) for r in S.caption_issues(items).collect())
    assert issues == [("CAPTION_NO_FIGURE", 9, 1), ("FIGURE_NO_CAPTION", 9, 1)]


def test_numbers_of_unplain_captions(spark):
    """A figure's number is read over any blank; a caption without a number, and a table's whose number doesn't follow a plain blank, leave the place."""
    md = ["Figure&nbsp;3.3 a", "Fig.&#160;&#xA0; 3-4 b", "Figure\u00a05 c", "Fig.~3.3 d", "Figure legend", "Fig", "Figure&amp;3.9", "Table&nbsp;3.9 e", "Table 3.8 f", "Table g"]
    rows = [("b", 3, 2 * i + k, ("table" if m.startswith("Table") else "figure") if k == 1 else "caption", m if k == 2 else "", i) for i, m in enumerate(md) for k in (1, 2)]
    items = spark.createDataFrame(rows, "book_id STRING, chapter INT, ord INT, kind STRING, md STRING, page INT")
    got = [(r.caption_ord, r.number, r.file) for r in S.figure_numbers(items).orderBy("ord").collect()]
    numbers = ["3_03", "3_04", "5", "3_03", "3_05", "3_06", "3_07", "3_01", "3_08", "3_03"]
    files = [f"figure_{n}.png" for n in numbers[:3]] + ["figure_3_03_2.png"] + [f"figure_{n}.png" for n in numbers[4:7]] + [f"table_{n}.md" for n in numbers[7:]]
    assert got == [(2 * i + 2, n, f) for i, (n, f) in enumerate(zip(numbers, files))]


def test_changed_numbers(spark):
    blocks = spark.createDataFrame([("b", "ch001-p0001-b001", 1, "dose 2.5 mg of 3"), ("b", "ch002-p0001-b001", 1, "give 7 mg")], "book_id STRING, block_id STRING, page INT, raw_text STRING")
    items = spark.createDataFrame([("b", 1, 1, "paragraph", 1, "dose 25 mg of 3"), ("b", 2, 1, "paragraph", 1, "give mg")], "book_id STRING, chapter INT, ord INT, kind STRING, page INT, md STRING")
    diff = Q.numeric_diff(blocks, items)
    assert sorted((r.chapter, r.code, r.token, r.severity) for r in diff.collect()) == [(1, "MISSING_NUMBER", "2.5", "HIGH"), (1, "UNEXPECTED_NUMBER", "25", "HIGH"), (2, "MISSING_NUMBER", "7", "HIGH")]
    assert [tuple(r) for r in Q.changed_numbers(diff).collect()] == [("b", 1, "HIGH", "CHANGED_NUMBER", "missing 2.5 / unexpected 25")]


def test_footnote_links(spark):
    items = spark.createDataFrame([("b", 1, "a<sup>1</sup> b<sup>1</sup> c<sup>2</sup>")], "book_id STRING, page INT, md STRING")
    notes = spark.createDataFrame([("b", 1, "p1n1"), ("b", 1, "p1s2")], "book_id STRING, page INT, label STRING")
    assert S.link_footnotes(items, notes).first().linked == "a[^p1n1] b<sup>1</sup> c<sup>2</sup>"


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalization", "gener"), ("adjustable", "adjust"), ("controlling", "control"), ("sky", "sky"), ("é", "é")])
def test_stem(word, want):
    assert stem(word) == want


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "long-term plan of long care"), (2, "term long plan"), (3, None), (4, "")], "id INT, body STRING")
    index = Index(docs, ["id"], "body")
    assert [r.id for r in index.match("long-term").collect()] == [1]
    assert {r.id for r in index.match("plan long").collect()} == {1, 2}
    assert index.match("   ").count() == 0 and index.match("absent plan").count() == 0
    index.save(str(tmp_path / "one"))
    assert {r.id for r in Index(docs, ["id"], "body").load(str(tmp_path / "one")).top("plan", 5).collect()} == {1, 2}
    assert index.snippets("term", k=1).first().snippet.count("[[term]]") == 1


def test_search_saved_as_unsaved(spark, tmp_path):
    rows = [("b", 1, 1, "Pain of the knee and the Ménière patient"), ("b", 1, 2, "knee pain, pain"), ("b", 2, 1, "patients complain of pain"), ("b", 2, 2, None), ("c", 1, 1, "no word")]
    schema = "book_id STRING, chapter INT, ord INT, text STRING"
    docs, key, unit = spark.createDataFrame(rows, schema), ["book_id", "chapter", "ord"], ["book_id", "chapter"]
    for stemmed in (False, True):
        index = Index(docs, key, "text", stemmed)
        index.save(str(tmp_path / f"s{stemmed}"), unit)
        saved = Index(docs, key, "text", stemmed).load(str(tmp_path / f"s{stemmed}"), unit)
        for q in ("pain", "knee pain", '"of pain"', "patient", "meniere", "MÉNIÈRE", "absent"):
            assert sorted(map(tuple, index.match(q).collect())) == sorted(map(tuple, saved.match(q).collect())), (stemmed, q)
    assert {tuple(r)[:3] for r in Index(docs, key, "text", True).match("patients").collect()} == {("b", 1, 1), ("b", 2, 1)}
    assert [tuple(r)[:3] for r in Index(docs, key, "text").match("meniere").collect()] == [("b", 1, 1)]


def test_a_chapter_is_replaced_in_the_index(spark, tmp_path):
    schema, key, unit, folder = "book_id STRING, chapter INT, ord INT, text STRING", ["book_id", "chapter", "ord"], ["book_id", "chapter"], str(tmp_path)
    old = [("b", 1, 1, "old words of one"), ("b", 1, 2, "old again"), ("b", 2, 1, "words of two")]
    new = [("b", 1, 1, "new words of one")]
    Index(spark.createDataFrame(old, schema), key, "text").save(folder, unit)
    Index(spark.createDataFrame(new, schema), key, "text").save(folder, unit, segment=1)
    now = spark.createDataFrame(new + old[2:], schema)
    saved, fresh = Index(now, key, "text").load(folder, unit), Index(now, key, "text")
    assert saved.match("old").count() == 0
    for q in ("words", "new", "two"):
        assert sorted(map(tuple, saved.match(q).collect())) == sorted(map(tuple, fresh.match(q).collect())), q


def test_search_filters(spark):
    docs = spark.createDataFrame([(1, 1, "list", "renal, cardiac", "pain"), (2, 2, "list", "renal", "pain"), (3, 1, "table", None, "pain")], "id INT, chapter INT, kind STRING, specialty STRING, text STRING")
    index = Index(docs, ["id"], "text")
    for where, want in ((only(), {1, 2, 3}), (only(chapter=1), {1, 3}), (only(kind="list"), {1, 2}), (only(specialty="cardiac"), {1}), (only(2, "list", "renal"), {2})):
        assert {r.id for r in index.match("pain", where).collect()} == want


def test_neighbouring_terms(spark):
    places = spark.createDataFrame([("b", 1, "T", "s", "h", None, "hepatitis nephritis arthritis, Wilson disease. Syndrome")], "book_id STRING, chapter INT, chapter_title STRING, section_id STRING, heading STRING, title STRING, text STRING")
    assert {r.term for r in V.index_terms(places).collect()} == {"hepatitis", "nephritis", "arthritis", "Wilson disease"}
