import random
import time

import pytest

from foliospark.llm import labelled
from foliospark.llm import markup as U
from foliospark.llm import split as P
from foliospark.session import table

MODEL = U.MarkupModel()


def accuracy(sample, state=lambda n: n.residue > 0.5):
    """Share of nodes in their labelled state, and the nodes that aren't."""
    n, wrong = 0, []
    for is_table, text, marks in sample:
        for node in U._walk(MODEL.mark(U.parse(text, is_table))):
            if node.kind != "root":
                n += 1
                if state(node) != marks[node.start]:
                    wrong.append((text, node.kind, node.name, node.start))
    return 1 - len(wrong) / n, wrong


def test_held_out_accuracy():
    by_hand, wrong = accuracy(labelled.held_out())
    assert by_hand >= 0.98, wrong
    composed, wrong = accuracy(labelled.pages(400, seed=labelled.SEED + 1))
    assert composed >= 0.98, wrong[:20]


def test_messages_decide():
    """Cells, breaks and emphasis of a table look alike whether it is a whole text or residue; what their parents tell makes the difference."""
    table = "<table><tr><th>a</th></tr><tr><td>b<br>c <b>d</b></td></tr></table>"
    assert MODEL.count(table, True) == 0 and MODEL.count(table, False) == 7
    alone = {}
    for parent in U._walk(U.parse(table, True)):
        for n in parent.children:
            a, b = MODEL.node[U._group(parent), U._observed(n)]
            tie = MODEL.tie[U._group(parent)]
            alone[n.start, n.name] = b * sum(t[1] for t in tie) > a * sum(t[0] for t in tie)
    assert any(alone.values())


@pytest.mark.parametrize("mark", ["{|\n", "`a ``b ", "$$", "<a ", "''", "{{a", "= \t", "\\textbf{", "<b>", "[[a", "~~~\n", "<!-- ", "\\begin{a}", "\\a[", "&#1", "```", "<a id=x> ", "\\item "])
def test_unclosed_markup_takes_linear_time(mark):
    text = mark * (1_000_000 // len(mark))
    start = time.process_time()
    MODEL.count(text)
    assert time.process_time() - start < 12


def test_any_mixture_of_marks_is_parsed():
    r = random.Random(5)
    marks = ["`", "``", "```", "````", "~~~", "\n", "\n\n", "$", "$$", "<b>", "</b>", "<!--", "-->", "{|", "|}", "{{", "}}", "[[", "]]", "''", "= ", " =", "\\a{", "}", "\\begin{x}", "\\end{x}", "<td>", "&lt;", "a", " ", "<br"]
    for n in range(4000):
        text = "".join(r.choice(marks) for _ in range(r.randint(1, 40)))
        root = MODEL.mark(U.parse(text, n % 3 == 0))
        for x in U._walk(root):
            assert 0 <= x.start <= x.end <= len(text) and 0 <= x.residue <= 1
            assert all(a.end <= b.start for a, b in zip(x.children, x.children[1:])), text
            assert not x.inner or all(x.inner[0] <= c.start and c.end <= x.inner[1] for c in x.children), text
        MODEL.clean(text)


def test_commands_at_any_depth():
    for depth in (3, 25, 90):
        assert MODEL.clean("a " + "\\textbf{" * depth + "x" + "}" * depth + " b").replace("*", "") == "a x b"
    assert MODEL.clean("\\emph{a <b>c} d</b> e").replace("*", "") == "a c d e"


@pytest.mark.parametrize(
    "text, table_kind, residue, clean",
    [
        ("a <i>b</i> c", False, True, "a *b* c"),
        ("<h2>Head</h2>\ntext", False, True, "## Head\n\ntext"),
        ("<ol><li>a</li><li>b</li></ol>", False, True, "1. a\n2. b"),
        ("x &amp; y &copy;", False, True, "x & y ©"),
        ("&lt;p&gt;a&lt;/p&gt;", False, True, "a"),
        ("see [[page|word]] {{x}}", False, True, "see word"),
        ("=== Head ===\ntext", False, True, "### Head\ntext"),
        ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", False, True, "- a\n- b"),
        ("\\begin{equation}\nr = \\frac{a}{b}\n\\end{equation}", False, True, "$$\nr = \\frac{a}{b}\n$$"),
        ("fall of 5\\% in \\emph{a}", False, True, "fall of 5% in *a*"),
        ("<table><tr><th>a</th></tr><tr><td>1|2</td></tr></table>", False, True, "| a |\n|---|\n| 1\\|2 |"),
        ("<table><tr><th>a</th></tr><tr><td>1<br>2</td></tr></table>", True, False, None),
        ("| a<br>b | c |\n|---|---|", True, True, None),
        ("Q&A, p < 0.05 > x, `<br>`, $\\frac{a}{b}$, <!-- <b> -->, <a id=\"r\"></a>[1]", False, False, None),
        ("```html\n<p>a</p>\n```", False, False, None),
        ("```\ncode\n```<br/>", False, True, None),
        ("$$\n\\alpha\n$$ and \\textbf{b}", False, True, "$$\n\\alpha\n$$ and **b**"),
        ("", False, False, None),
        ("<b>" * 3000, False, True, None),
        ("word " * 50000 + "<u>x</u>", False, True, None),
    ],
)
def test_residue(text, table_kind, residue, clean):
    assert (MODEL.count(text, table_kind) > 0) == residue
    cleaned = MODEL.clean(text, table_kind)
    if clean is not None:
        assert cleaned == clean
    if not residue:
        assert cleaned == text
    if not table_kind:
        assert MODEL.count(cleaned, table_kind) == 0


def test_all_elements_and_namespaces():
    for name in "acronym area base bdi bdo data dialog math menu meter mfrac mi output rp rt ruby slot track o:p st1:place w:r mml:math".split():
        assert MODEL.count(f"word <{name}>x</{name}> word") > 0 and MODEL.clean(f"word <{name}>x</{name}> word").split()[0] == "word", name
        assert "<" not in MODEL.clean(f"word <{name}>x</{name}> word"), name
    assert MODEL.clean("a <o:p></o:p>b <ns:item id=\"1\">c</ns:item> <ruby>d<rp>(</rp><rt>e</rt><rp>)</rp></ruby>") == "a b c d(e)"
    for plain in ("see <https://x.org/a>, <mailto:a@b.c>, <urn:isbn:1>, <doi:abc> and <word>", "if a <b:2 or c> d", "`<o:p>` stays"):
        assert MODEL.count(plain) == 0 and MODEL.clean(plain) == plain


def test_markup_escaped_many_times():
    for times in (1, 8, 9, 40):
        assert MODEL.clean("word &" + "amp;" * times + "lt;b&" + "amp;" * times + "gt;x&" + "amp;" * times + "lt;/b&" + "amp;" * times + "gt;") == "word **x**", times


def test_found_and_clean_on_rows(spark):
    items = spark.createDataFrame([("b", "1", None, "paragraph", 1), ("b", "2", "<b>x</b>", None, 1), ("b", "2", "<b>x</b>", None, 1), ("b", "3", "plain", "list", 1), (None, None, "", "list", 1)], "book_id STRING, block_id STRING, md STRING, kind STRING, residue INT")
    blocks = spark.createDataFrame([("b", "1", "<table></table>", "table"), ("b", "2", "<table></table>", "list")], "book_id STRING, block_id STRING, markdown STRING, block_type STRING")
    assert {tuple(r) for r in U.found(items, blocks).collect()} == {("md", "b", "2"), ("markdown", "b", "2")}
    assert U.clean(items, blocks).count() == 7
    assert U.found(items.limit(0), blocks.limit(0)).count() == 0


def test_trigger_misses_no_residue(spark, data):
    rows = [r.markdown for r in table(spark, data, "blocks").select("markdown").collect() if r.markdown]
    df = spark.createDataFrame([(t,) for t in rows], "t STRING")
    passed = {r.t for r in df.where(U.may_hold_markup(df.t)).collect()}
    assert all(MODEL.count(t) == 0 for t in set(rows) - passed)


TEXTS = ["word " * 900, "A sentence here. " * 300, "x" * 5000, "\n\n".join("para " * 40 for _ in range(20)), "```\n" + "code line\n" * 500 + "```", "é" * 2001, " " * 4000, "a. B" * 1000]


@pytest.mark.parametrize("limit, overlap", [(1000, 100), (1000, 0), (700, 699), (50, 10), (1, 0), (1, 5)])
def test_pieces(limit, overlap):
    for text in TEXTS:
        pieces = P.split(text, limit, overlap)
        real = max(0, min(overlap, limit - 1))
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(0 < e - s <= limit for s, e in pieces)
        assert all(b[0] == a[1] - real for a, b in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("limit", [2, 7, 40])
def test_every_overlap_below_the_limit_is_kept(limit):
    text = "One two. Three, four\n\nfive - six " * 4
    for overlap in range(limit):
        pieces = P.split(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < e - s <= limit for s, e in pieces)
        assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(pieces, pieces[1:])), overlap


def test_several_texts_of_one_key(spark):
    items = spark.createDataFrame([("b", "1", "x" * 20, "list"), ("b", "1", "y" * 20, "list"), ("b", "1", "y" * 20, "list")], "book_id STRING, block_id STRING, md STRING, kind STRING")
    blocks = spark.createDataFrame([], "book_id STRING, block_id STRING, markdown STRING, block_type STRING")
    limits = spark.createDataFrame([("list", 10, 0)], "kind STRING, max_chars INT, overlap_chars INT")
    assert sorted(r.piece[0] for r in P.pieces(items, blocks, limits).collect()) == ["x", "x", "y", "y"]


def test_cuts_at_the_strongest_boundaries():
    text = "\n\n".join("First sentence here. Second one there." for _ in range(12))
    assert all(text[e - 2 : e] == "\n\n" for _, e in P.split(text, 200, 0)[:-1])
    text = "One sentence of some words. " * 40
    assert all(text[:e].endswith(". ") for _, e in P.split(text, 150, 20)[:-1])


def test_found_is_by_length(spark):
    limits = spark.createDataFrame([("list", 10, 3), ("list", 12, 2), ("none", None, None)], "kind STRING, max_chars INT, overlap_chars INT")
    items = spark.createDataFrame([("b", "1", "x" * 10, "list", 1), ("b", "2", "é " * 6, "list", 1), ("b", "2", "é " * 6, "list", 1), ("b", "3", "y" * 999, "other", 1), ("b", "4", None, "list", 1), ("b", "5", "z" * 99, "none", 1)], "book_id STRING, block_id STRING, md STRING, kind STRING, piece_no INT")
    blocks = spark.createDataFrame([("b", "9", "w" * 11, "list")], "book_id STRING, block_id STRING, markdown STRING, block_type STRING")
    assert {tuple(r) for r in P.found(items, blocks, limits).collect()} == {("md", "b", "2"), ("markdown", "b", "9")}
    whole = P.pieces(items, blocks, limits).where("block_id in ('1', '3', '5')").collect()
    assert len(whole) == 3
    assert P.found(items.limit(0), blocks.limit(0), limits).count() == 0 and P.found(items, blocks, limits.limit(0)).count() == 0
