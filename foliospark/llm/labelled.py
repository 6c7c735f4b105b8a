"""Labelled pages for the markup model: composed pages to train on, and pages labelled by hand that are held out.

A composed page is drawn from a grammar of content and residue: prose, code, formulas, comments and whole tables on one side, HTML, wiki markup and
LaTeX on the other, nested in each other as they are met. Each character is labelled as it is written, so the sample is as large as wanted;
``TRAINING_PAGES`` bounds it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Pages that the model is trained on, and the seed they are drawn with.
TRAINING_PAGES, SEED = 1500, 3

# Pages labelled by hand: what stands between ⟪ and ⟫ is residue, all other markup is content. The flag marks texts of a table kind.
HELD_OUT = [
    (False, "⟪<p>⟫One ⟪<b>bold</b>⟫ word and a ⟪<span class=\"x\">span</span>⟫.⟪</p>⟫"),
    (False, "⟪<div>\n<p>Nested <em>text</em></p>\n</div>⟫"),
    (False, "⟪<ul><li>first</li><li>second</li></ul>⟫ then ⟪<br/>⟫ and ⟪<br>⟫"),
    (False, "⟪<h3>Title</h3>⟫\nText &lt is no entity, but ⟪&lt;⟫ and ⟪&nbsp;⟫ and ⟪&#8220;⟫ are."),
    (False, "A line ⟪&amp;⟫ another ⟪&quot;⟫word⟪&#x201D;⟫."),
    (False, "⟪<table><tr><td>a</td><td>b</td></tr></table>⟫"),
    (False, "Before\n⟪<table><tr><th>a</th></tr><tr><td><b>b</b></td></tr></table>⟫"),
    (True, "<table><tr><th>a</th><th></th></tr><tr><td>b</td><td>1</td></tr></table>"),
    (True, "<table>\n  <tr><th>a &lt; b</th></tr>\n  <tr><td>b<br>c</td></tr>\n</table>"),
    (True, "<table><thead><tr><th colspan=\"2\">a</th></tr></thead><tbody><tr><td><sup>b</sup></td><td>&amp;</td></tr></tbody></table>"),
    (True, "| a | b |\n|---|---|\n| ⟪<b>c</b>⟫ | d⟪<br>⟫e |"),
    (True, "Title\n⟪<table><tr><td>a</td></tr></table>⟫"),
    (False, "Write `<br>` or `\\item` here, and `&amp;` there."),
    (False, "```html\n<p>text</p>\n<br>\n```"),
    (False, "```latex\n\\textbf{word} \\cite{x}\n```\nand ⟪\\textbf{word}⟫"),
    (False, "```\n{{template}} [[link]] &lt;\n```"),
    (False, "~~~\n<div>\n~~~"),
    (False, "Clearance is $\\frac{U \\cdot V}{P}$ by convention, ⟪\\emph{not}⟫ otherwise."),
    (False, "$$\n\\Delta = \\alpha_{1} - \\beta^{2}\n$$"),
    (False, "$a &lt; b$ and $\\text{<b>}$"),
    (False, "## Heading\n<!-- section_id: a-b -->"),
    (False, "<!-- <p>hidden</p> &amp; \\cite{x} [[y]] -->"),
    (False, "<a id=\"ref-1\"></a>[1] A name.\n\n<a id=\"ref-2\"></a>[2] Another."),
    (False, "⟪<a href=\"#top\">up</a>⟫ and ⟪<a href='x'>a ''b''</a>⟫"),
    (False, "⟪[[page|word]]⟫ and ⟪[[word]]⟫ and ⟪{{main|page}}⟫"),
    (False, "⟪'''bold'''⟫ and ⟪''italic''⟫"),
    (False, "⟪== Heading ==⟫\ntext ⟪{{citation needed}}⟫"),
    (False, "⟪{| class=\"wikitable\"\n|-\n| a || b\n|}⟫"),
    (False, "⟪\\section{Title}⟫ text ⟪~\\cite{a}⟫, ⟪\\textit{b}⟫, 5⟪\\%⟫, R⟪\\&⟫D"),
    (False, "⟪\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}⟫"),
    (False, "⟪\\begin{equation}\nr = \\frac{a}{b + c}\n\\end{equation}⟫"),
    (False, "⟪<ref name=\"a\" />⟫ ⟪<font>b</font>⟫ ⟪<u>c</u>⟫ ⟪</div>⟫"),
    (False, "The Q&A and p < 0.05 and a > b stay; **bold**, `code`, [link](x.md)."),
]

_WORDS = "water field winter copper engine garden letter market number paper river stone table theory village window sample model method result change figure over under with from about".split()
_ENTITIES = "&amp; &lt; &gt; &nbsp; &quot; &copy; &eacute; &ndash; &#8211; &#xA9;".split()
_INLINE = "b i em strong u span sub sup small font code cite abbr".split()
_BLOCK = "p div section article blockquote center".split()

Segments = list[tuple[str, bool]]


class _Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int = 4) -> str:
        return " ".join(self.r.choice(_WORDS) for _ in range(self.r.randint(1, n)))

    def symbols(self) -> str:
        """Markup as it stands in code, comments and the like."""
        r = self.r
        return r.choice([f"<{r.choice(_INLINE)}>", "<br>", f"\\{r.choice(['item', 'textbf{a}', 'cite{x}'])}", "&amp;", "[[page]]", "{{note}}", f"<p>{self.words(2)}</p>", self.words(2), "x = 1"])

    def formula(self) -> str:
        return self.r.choice(["\\frac{a}{b}", "\\alpha_{1} - \\beta", "x^{2} + \\sqrt{y}", "a + b", "\\text{rate} \\cdot t", "\\text{<b>}", "\\mathrm{a &lt; b}"])

    def content(self) -> Segments:
        """Markup that stays, wherever it stands."""
        r = self.r
        return [(r.choice([lambda: f"`{self.symbols()}`", lambda: f"${self.formula()}$", lambda: f"<!-- {self.symbols()} {self.words(2)} -->", lambda: f'<a id="{r.choice(_WORDS)}"></a>', lambda: "p < 0.05", lambda: "Q&A", lambda: f"**{self.words(2)}**"])(), False)]

    def inline(self, depth: int = 0) -> Segments:
        r, kind = self.r, self.r.random()
        if kind < 0.35:
            return [(self.words(), False)]
        if kind < 0.5:
            return self.content()
        if kind < 0.62:
            return [(r.choice(_ENTITIES), True)]
        if kind < 0.82:
            name = r.choice(_INLINE + ["a"])
            inner = self.run(depth + 1, 2) if depth < 3 else [(self.words(2), False)]
            return [(f'<a href="{r.choice(_WORDS)}">' if name == "a" else f"<{name}>", True), *inner, (f"</{name}>", True)]
        if kind < 0.9:
            return [(r.choice([f"[[{self.words(1)}|{self.words(2)}]]", f"[[{self.words(1)}]]", f"'''{self.words(2)}'''", f"''{self.words(2)}''", "{{" + self.words(2) + "}}"]), True)]
        if kind < 0.93:
            return [(r.choice(["<br>", "<br/>", "</div>", "<hr>"]), True)]
        return [(r.choice([f"\\textbf{{{self.words(2)}}}", f"\\emph{{{self.words(1)}}}", f"\\cite{{{self.words(1)}}}", "\\%", "\\&"]), True)]

    def run(self, depth: int = 0, n: int = 4) -> Segments:
        out: Segments = [(self.words(), False)]
        for _ in range(self.r.randint(1, n)):
            out += [(" ", False), *self.inline(depth)]
        return out

    def rows(self, residue: bool) -> Segments:
        """An HTML table, as a whole in the one state or the other."""
        r, text = self.r, "<table>"
        for _ in range(r.randint(1, 3)):
            cells = "".join(f"<{c}>{self.words(2)}{r.choice(['', '', '', '<br>', ' &lt; 5', '<sup>a</sup>', ' <b>x</b>'])}</{c}>" for c in [r.choice(["td", "td", "th"])] * r.randint(1, 3))
            text += f"<tr>{cells}</tr>"
        return [(text + "</table>", residue)]

    def block(self) -> Segments:
        r, kind = self.r, self.r.random()
        if kind < 0.3:
            return self.run()
        if kind < 0.45:
            name = r.choice(_BLOCK)
            inner = self.run() if r.random() < 0.7 else [("\n", False), *self.block(), ("\n", False)]
            return [(f"<{name}>", True), *inner, (f"</{name}>", True)]
        if kind < 0.53:
            name = r.choice(["ul", "ol"])
            items = [s for _ in range(r.randint(1, 3)) for s in [("<li>", True), *self.run(2, 1), ("</li>", True)]]
            return [(f"<{name}>", True), *items, (f"</{name}>", True)]
        if kind < 0.63:
            return self.rows(True)
        if kind < 0.72:
            return [(r.choice([f"```\n{self.symbols()}\n{self.symbols()}\n```", f"~~~\n{self.symbols()}\n~~~", f"$$\n{self.formula()}\n$$"]), False)]
        if kind < 0.8:
            return [(f"## {self.words()}\n<!-- section_id: {self.words(1)} -->", False)]
        if kind < 0.86:
            return [(r.choice([f"== {self.words(2)} ==", f"{{| class=\"x\"\n|-\n| {self.words(1)} || {self.words(1)}\n|}}", f"<h2>{self.words(2)}</h2>"]), True)]
        if kind < 0.93:
            env, body = r.choice([("itemize", f"\\item {self.words()}\n\\item {self.words()}"), ("equation", self.formula()), ("quote", self.words())])
            return [(f"\\begin{{{env}}}\n{body}\n\\end{{{env}}}", True)]
        return [(f"\\{r.choice(['section', 'subsection', 'label'])}{{{self.words(2)}}}", True)]

    def table_page(self) -> Segments:
        r, kind = self.r, self.r.random()
        if kind < 0.4:
            return self.rows(False)
        if kind < 0.6:
            return [(self.words() + "\n", False), *self.rows(True)]
        cells = [s for _ in range(2) for s in [("| ", False), *(self.inline(3) if r.random() < 0.5 else [(self.words(2), False)]), (" ", False)]]
        return [(f"| {self.words(1)} | {self.words(1)} |\n|---|---|\n", False), *cells, ("|", False)]


def pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[tuple[bool, str, list[bool]]]:
    """(of a table kind, text, for each character whether it's residue) of n composed pages."""
    g = _Grammar(seed)
    for i in range(n):
        is_table = i % 4 == 3
        parts = g.table_page() if is_table else [s for k in range(g.r.randint(1, 4)) for s in ([("\n\n", False)] if k else []) + g.block()]
        yield is_table, "".join(t for t, _ in parts), [f for t, f in parts for _ in t]


def held_out() -> Iterator[tuple[bool, str, list[bool]]]:
    """The pages labelled by hand, in the same form."""
    for is_table, page in HELD_OUT:
        text, flags, inside = [], [], False
        for c in page:
            if c in "⟪⟫":
                inside = c == "⟪"
                continue
            text.append(c)
            flags.append(inside)
        yield is_table, "".join(text), flags
