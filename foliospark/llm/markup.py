"""Markup residue in Markdown texts (problem 3).

Method: a tree-structured graphical model. A text is parsed to a tree of markup nodes (HTML elements and entities, wiki markup, LaTeX
commands and environments, code, formulas, comments). Each node is either wanted content or residue. Potentials tie the state of a node to
what it is and to the state of its parent, by the kind of the parent; they are counted from labelled pages. Sum-product messages go from
the leaves up and from the root down, and give the marginal of each node: cells, line breaks and emphasis are content in a table that is
a whole text, and residue in any other. Residue is turned into Markdown, all other text stays as it is.

Texts are parsed in one walk: what closes a code span or a wiki table is looked up among their ends, so that openers that nothing closes cost
no more than others.

Most texts hold no character that opens markup; they never leave the JVM.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import labelled
from foliospark.session import ship

# Element names of HTML, those without content, those that part blocks. The first are the standard's, obsolete ones too, and those
# of wiki texts; then those of MathML, and those of SVG that aren't words of their own.
_ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas caption center cite code "
    "col colgroup command content data datalist dd del details dfn dialog dir div dl dt element em embed fencedframe fieldset figcaption figure font footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe image img input ins isindex kbd keygen label legend li link listing main map mark "
    "marquee math menu menuitem meta meter multicol nav nextid nobr noembed noframes noscript object ol optgroup option output p param picture plaintext portal "
    "pre progress q rb rbc references ref rp rt rtc ruby nowiki gallery s samp script search section select selectedcontent shadow slot small source spacer span "
    "strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp "
    "annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "circle clippath defs ellipse foreignobject g lineargradient path polygon polyline radialgradient rect textpath tspan"
).split()
#: Names with a namespace. A prefix of one letter can't be the scheme of a link in angle brackets; a longer one is none if it's known, if an
#: attribute follows, or in an end tag.
_SPACED = r"[a-z]:[a-z][\w.-]*|(?:st\d|mml|math|svg|html|xhtml|epub|xsl|xsi|rdf|tei|jats|xlink|mc|wp|pic|dc|fb|ce|sb):[a-z][\w.-]*"
_SPACED_OPEN = _SPACED + r"|[a-z][\w-]+:[a-z][\w.-]*(?=\s+[\w:-]+\s*=)"
_SPACED_CLOSE = r"[a-z][\w-]*:[a-z][\w.-]*"
_VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "address", "figure", "figcaption", "center", "details", "summary", "dl", "dd", "dt", "body", "html", "head", "form", "fieldset", "dialog", "search", "hgroup", "frameset", "noframes", "marquee"}

_LEX = re.compile(
    rf"""(?P<fence>^[ \t>]*(?P<f>```++|~~~++)[^\n]*+\n(?:.*?\n)?[ \t>]*(?P=f)[`~]*(?![`~\w])|^[ \t>]*(?:```++|~~~++)[^\n]*+\n.*\Z)
    |(?P<code>(?<!`)`++)
    |(?P<display>\$\$.+?\$\$)
    |(?P<formula>(?<![\\$])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?!\d))
    |(?P<comment><!--.*?(?:-->|\Z))
    |(?P<anchor><a\s+(?:id|name)\s*=\s*[^<>]*>\s*</a>)
    |(?P<close></(?P<cname>{"|".join(_ELEMENTS)}|{_SPACED_CLOSE})\s*>)
    |(?P<open><(?P<oname>{"|".join(_ELEMENTS)}|{_SPACED_OPEN})(?:\s[^<>]*|/)?>)
    |(?P<doctype><![A-Za-z][^<>]*>)
    |(?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9A-Fa-f]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});)
    |(?P<wtable>^\{{\|)
    |(?P<template>\{{\{{[^{{}}]+\}}\}})
    |(?P<wlink>\[\[(?P<wt>[^\[\]\n]+)\]\](?!\())
    |(?P<wbold>'''(?P<wb>[^'\n]+)''')
    |(?P<wital>''(?P<wi>[^'\n]+)'')
    |(?P<whead>^(?P<we>={{1,6}})(?P<wh>[^=\n]+)(?P=we)[ \t]*$)
    |(?P<env>\\begin\{{(?P<en>[A-Za-z]+\*?)\}})
    |(?P<endenv>\\end\{{(?P<xn>[A-Za-z]+\*?)\}})
    |(?P<command>~?\\[A-Za-z]+\*?)
    |(?P<escape>\\[%&])""",
    re.S | re.M | re.X | re.I,
)
#: What a text must hold to be parsed at all; anything that _LEX finds holds one of these.
TRIGGER = r"[<&\\`$]|\[\[|\{\{|\{\||''|(?m)^=[^\n]*=[ \t]*$"


#: Depth from which elements are leaves: their marks are residue like others, only what they hold isn't below them any more.
MAX_DEPTH = 100


@dataclass
class Node:
    kind: str
    start: int
    end: int
    inner: tuple[int, int] | None = None
    name: str = ""
    children: list["Node"] = field(default_factory=list)
    residue: float = 0.0


def _braces(text: str) -> dict[int, int]:
    """Of each brace that is closed: its place, and the place behind the one that closes it."""
    open_at, out = [], {}
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            open_at.append(m.start())
        elif open_at:
            out[open_at.pop()] = m.end()
    return out


class _Ends:
    """Where code spans and wiki tables of a text end."""

    def __init__(self, text: str):
        self.ticks: dict[int, list[int]] = {}
        for m in re.finditer("`+", text):
            self.ticks.setdefault(m.end() - m.start(), []).append(m.start())
        self.gaps = [m.start() for m in re.finditer(r"\n(?=\n)", text)]
        self.tables = [m.end() for m in re.finditer(r"^\|\}", text, re.M)]
        self.braces = _braces(text)

    def code(self, start: int, end: int) -> int:
        """End of a code span that these backticks open: the next as many, in the same paragraph; 0 if there are none."""
        n = end - start
        runs = self.ticks.get(n, [])
        i = bisect_left(runs, start)
        if i == len(runs) or runs[i] != start:  # a part of a longer run, cut by the place where the walk begins or ends
            return 0
        i += 1
        gap = bisect_left(self.gaps, end)
        return runs[i] + n if i < len(runs) and (gap == len(self.gaps) or self.gaps[gap] >= runs[i]) else 0

    def table(self, end: int) -> int:
        i = bisect_left(self.tables, end + 2)
        return self.tables[i] if i < len(self.tables) else 0


def _lex(text: str, lo: int, hi: int, ends: _Ends) -> Iterator[tuple[str, re.Match, int]]:
    """(kind, match, end) of the tokens between two places. The receiver may send a place to go on at."""
    at = lo
    while at < hi:
        m = _LEX.search(text, at, hi)
        if not m:
            return
        kind = m.lastgroup if m.lastgroup in _KINDS else next(k for k in _KINDS if m.group(k) is not None)
        end = ends.code(m.start(), m.end()) if kind == "code" else ends.table(m.end()) if kind == "wtable" else m.end()
        if not end or end > hi or (kind == "entity" and m.group()[1] != "#" and m.group()[1:] not in html5):
            at = m.end()
            continue
        on = yield kind, m, end
        at = max(end, on or 0)


_KINDS = ("fence", "code", "display", "formula", "comment", "anchor", "close", "open", "doctype", "entity", "wtable", "template", "wlink", "wbold", "wital", "whead", "env", "endenv", "command", "escape")
_CLOSED = {"fence", "code", "display", "formula", "comment", "wtable", "template", "wlink", "wbold", "wital", "whead"}


def parse(text: str, is_table: bool = False) -> Node:
    """The tree of a text; the root spans it all. An element without an end, or an end without a beginning, is a leaf."""
    root = Node("root", 0, len(text), (0, len(text)))
    ends, todo = _Ends(text), [root]
    while todo:
        _fill(text, todo.pop(), ends, todo)
    stripped = text.strip()
    tops = root.children
    if is_table and len(tops) == 1 and tops[0].name == "table" and text[tops[0].start : tops[0].end] == stripped:
        tops[0].kind = "whole-table"
    return root


#: Length of what opens and closes those whose inside is theirs alone.
_RIM = {"code": lambda m: (len(m.group()),) * 2, "display": lambda m: (2, 2), "formula": lambda m: (1, 1), "comment": lambda m: (4, 3 if m.group().endswith("-->") else 0), "fence": lambda m: (3, 3)}


def _fill(text: str, top: Node, ends: _Ends, todo: list[Node]) -> None:
    """The nodes inside of one; those that are closed in themselves are put off. Commands hold what their braces hold, and stand on the stack until
    they end, like elements."""
    lo, hi = top.inner
    stack: list[Node] = [top]
    open_commands: list[int] = []  # their places in the stack
    lexer = _lex(text, lo, hi, ends)
    on = None
    while True:
        try:
            kind, m, end = lexer.send(on)
        except StopIteration:
            break
        on = None
        while open_commands and m.start() >= stack[open_commands[-1]].inner[1]:
            _drop(stack, open_commands.pop())
            stack.pop()
        if open_commands and end > stack[open_commands[-1]].inner[1]:
            # What begins in the braces of a command and ends behind them is no token of it.
            lexer = _lex(text, stack[open_commands[-1]].inner[1], hi, ends)
            continue
        here = stack[-1].children
        if kind in _CLOSED:
            node = Node(kind, m.start(), end, name=kind)
            if kind in ("wlink", "wbold", "wital", "whead"):
                node.inner = m.span({"wlink": "wt", "wbold": "wb", "wital": "wi", "whead": "wh"}[kind])
            elif kind in _RIM:
                a, b = _RIM[kind](m)
                node.inner = (min(m.start() + a, end), max(m.start() + a, end - b)) if end - m.start() > a + b else None
            if node.inner and _group(top) != "verbatim":  # code in code is code
                todo.append(node)
            here.append(node)
        elif kind == "open":
            name = m.group("oname").lower()
            node = Node("element", m.start(), m.end(), name=name)
            here.append(node)
            if name not in _VOID and not m.group().endswith("/>") and len(stack) < MAX_DEPTH:
                node.inner = (m.end(), m.end())
                stack.append(node)
        elif kind == "env":
            node = Node("env", m.start(), m.end(), (m.end(), m.end()) if len(stack) < MAX_DEPTH else None, m.group("en"))
            here.append(node)
            if node.inner:
                stack.append(node)
        elif kind in ("close", "endenv"):
            name, what = (m.group("cname").lower(), "element") if kind == "close" else (m.group("xn"), "env")
            floor = open_commands[-1] if open_commands else 0
            at = next((i for i in range(len(stack) - 1, floor, -1) if stack[i].kind == what and stack[i].name == name), 0)
            if at:
                _drop(stack, at)
                node = stack.pop()
                node.inner, node.end = (node.inner[0], m.start()), m.end()
            else:
                here.append(Node("stray", m.start(), m.end(), name=name))
        elif kind == "command":
            stop, inner = m.end(), None
            while stop < hi and text[stop] == "[" and (close := text.find("]", stop, min(hi, stop + 200))) > 0:
                stop = close + 1
            while stop < hi and text[stop] == "{" and 0 < (close := ends.braces.get(stop, 0)) <= hi:
                inner, stop = (stop + 1, close - 1), close
            node = Node("command", m.start(), stop, inner, m.group().lstrip("~").lstrip("\\").rstrip("*"))
            here.append(node)
            if inner and len(stack) < MAX_DEPTH:
                open_commands.append(len(stack))
                stack.append(node)
                on = inner[0]
            else:
                on = stop
        else:
            here.append(Node({"doctype": "element"}.get(kind, kind), m.start(), m.end(), name=kind))
    _drop(stack, 0)
    for n in _walk(top):
        n.children.sort(key=lambda c: c.start)


def _drop(stack: list[Node], at: int) -> None:
    """Ends what is open above a place of the stack: commands end with their braces, elements without an end become leaves, and what was in
    them falls to what holds them."""
    while len(stack) > at + 1:
        orphan = stack.pop()
        if orphan.kind != "command":
            orphan.inner = None
            stack[-1].children += orphan.children
            orphan.children = []


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += n.children


def _observed(n: Node) -> str:
    if n.kind == "element":
        return "cell" if n.name in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "col", "colgroup") else "element"
    return n.kind


def _group(parent: Node) -> str:
    if parent.kind in ("fence", "code", "display", "formula", "comment"):
        return "verbatim"
    if parent.kind == "whole-table" or parent.name == "table" or _observed(parent) == "cell":
        return "table"
    return "root" if parent.kind == "root" else "inner"


class MarkupModel:
    """Potentials of content (0) and residue (1), counted from labelled pages (``labelled.pages``) with a pseudo-count.

    ``tie``: how often a node is in a state, given the state of its parent; ``node``: how often a node of that state is of a kind. Both by the
    group of the parent, so that the many cells of a table, likely in either state, say nothing about the table.
    """

    def __init__(self, sample: Iterable[tuple[bool, str, list[bool]]] | None = None, pseudo: float = 0.1):
        seen: Counter = Counter()
        tied: Counter = Counter()
        states: Counter = Counter()
        kinds = set()
        for is_table, text, marks in labelled.pages() if sample is None else sample:
            for parent in _walk(parse(text, is_table)):
                for c in parent.children:
                    x, y = int(parent.kind != "root" and marks[parent.start]), int(marks[c.start])
                    kinds.add(_observed(c))
                    seen[_group(parent), _observed(c), y] += 1
                    states[_group(parent), y] += 1
                    tied[_group(parent), x, y] += 1
        groups = ("verbatim", "table", "inner", "root")
        kinds = sorted(kinds | set(_KINDS) - {"close", "open", "endenv", "doctype"})
        self.node, self.tie = {}, {}
        for g in groups:
            n = [states[g, y] for y in (0, 1)]
            # A state or kind that the sample hardly shows falls back to what its group shows, so that it speaks for neither side.
            of_kind = {k: (seen[g, k, 0] + seen[g, k, 1] + pseudo) / (sum(n) + pseudo * len(kinds)) for k in kinds}
            of_state = [(m + pseudo) / (sum(n) + 2 * pseudo) for m in n]
            for k in kinds:
                self.node[g, k] = [(seen[g, k, y] + of_kind[k]) / (n[y] + 1) for y in (0, 1)]
            self.tie[g] = [[(tied[g, x, y] + of_state[y]) / (tied[g, x, 0] + tied[g, x, 1] + 1) for y in (0, 1)] for x in (0, 1)]

    def mark(self, root: Node) -> Node:
        """Sets the marginal of residue of every node. The root is content."""
        order = []
        stack: list[tuple[Node, Node | None]] = [(root, None)]
        while stack:
            n, p = stack.pop()
            order.append((n, p))
            stack += [(c, n) for c in n.children]
        up: dict[int, list[float]] = {}  # product of what a node sees and what its children tell
        told: dict[int, list[float]] = {}  # message of a node to its parent
        for n, p in reversed(order):
            own = [1.0, 0.0] if p is None else list(self.node.get((_group(p), _observed(n)), [0.5, 0.5]))
            for c in n.children:
                own = [a * b for a, b in zip(own, told[id(c)])]
                s = own[0] + own[1]
                own = [v / s for v in own]
            up[id(n)] = own
            if p is not None:
                t = self.tie[_group(p)]
                told[id(n)] = [t[x][0] * own[0] + t[x][1] * own[1] for x in (0, 1)]
        down: dict[int, list[float]] = {}  # message of the parent
        for n, p in order:
            if p is None:
                down[id(n)] = [1.0, 0.0]
            else:
                t = self.tie[_group(p)]
                rest = [b * d / m if m else 0.0 for b, d, m in zip(up[id(p)], down[id(p)], told[id(n)])] if p is not root else [1.0, 0.0]
                down[id(n)] = [rest[0] * t[0][y] + rest[1] * t[1][y] for y in (0, 1)]
            a, b = (u * d for u, d in zip(up[id(n)], down[id(n)]))
            n.residue = b / (a + b) if a + b else 0.0
            s = sum(down[id(n)]) or 1.0
            down[id(n)] = [v / s for v in down[id(n)]]
        return root

    def count(self, text: str, is_table: bool = False) -> int:
        """Number of residue nodes."""
        return sum(n.residue > 0.5 for n in _walk(self.mark(parse(text, is_table))) if n.kind != "root")

    def clean(self, text: str, is_table: bool = False) -> str:
        """Clean Markdown. Markup that was written in entities comes to light when they are resolved, so the result is cleaned until nothing changes."""
        seen: set[int] = set()
        while (h := hash(text)) not in seen:
            seen.add(h)
            root = self.mark(parse(text, is_table))
            out = _render(text, root, root.inner)
            if out == text:
                break
            text = re.sub(r"[ \t]+(?=\n|$)", "", re.sub(r"\n{3,}", "\n\n", out)).strip("\n")
        return text


@lru_cache(1)
def trained() -> MarkupModel:
    return MarkupModel()


def _render(text: str, node: Node, span: tuple[int, int]) -> str:
    out, at = [], span[0]
    for c in node.children:
        out.append(text[at : c.start])
        out.append(text[c.start : c.end] if c.residue <= 0.5 else _convert(text, c))
        at = c.end
    out.append(text[at : span[1]])
    return "".join(out)


def _rows_to_table(rows: list[list[str]]) -> str:
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n\n" + "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) + "\n\n"


def _cells(text: str, table: Node) -> list[list[str]]:
    rows: list[list[str]] = []
    for n in sorted(_walk(table), key=lambda n: n.start):
        if n.kind == "element" and n.name == "tr":
            rows.append([])
        elif n.kind == "element" and n.name in ("td", "th"):
            if not rows:
                rows.append([])
            rows[-1].append(_render(text, n, n.inner) if n.inner else "")
    return rows


_EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "strike": "~~", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
_LATEX_EMPHASIS = {"textbf": "**", "emph": "*", "textit": "*", "textsl": "*", "texttt": "`"}
_LATEX_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}


def _wrap(mark: str, inner: str) -> str:
    return f"{mark}{inner}{mark}" if inner.strip() else inner


def _convert(text: str, n: Node) -> str:
    """A residue node as Markdown."""
    raw = text[n.start : n.end]
    inner = _render(text, n, n.inner) if n.inner else ""
    if n.kind == "entity":
        return html.unescape(raw).replace("\xa0", " ")
    if n.kind == "escape":
        return raw[1:]
    if n.kind == "wlink":
        return inner.rpartition("|")[2]
    if n.kind in ("wbold", "wital"):
        return _wrap("**" if n.kind == "wbold" else "*", inner)
    if n.kind == "whead":
        level = len(raw) - len(raw.lstrip("="))
        return "#" * max(level, 1) + " " + inner.strip()
    if n.kind == "wtable":
        rows = [[c.rpartition(" | ")[2] for c in re.split(r"\|\||!!", row.strip()[1:])] for part in re.split(r"^\|-.*$", raw[2:-2].partition("\n")[2], flags=re.M) for row in ["||".join(x.strip() if i == 0 else x.strip()[1:] for i, x in enumerate(part.strip().split("\n")))] if part.strip()]
        return _rows_to_table(rows)
    if n.kind in ("template", "stray"):
        return ""
    if n.kind == "env":
        body = inner.strip("\n")
        name = n.name.rstrip("*")
        if name in ("equation", "align", "gather", "displaymath", "eqnarray", "math"):
            return "\n\n$$\n" + text[n.inner[0] : n.inner[1]].strip("\n") + "\n$$\n\n" if n.inner else ""
        if name in ("verbatim", "lstlisting"):
            return f"\n\n```\n{body}\n```\n\n"
        if name == "enumerate":
            numbers = iter(range(1, 1 << 30))
            return "\n\n" + re.sub(r"^- ", lambda _: f"{next(numbers)}. ", body, flags=re.M) + "\n\n"
        return "\n\n" + body + "\n\n"
    if n.kind == "command":
        if n.name in _LATEX_EMPHASIS:
            return _wrap(_LATEX_EMPHASIS[n.name], inner)
        if n.name in _LATEX_LEVEL:
            return "#" * _LATEX_LEVEL[n.name] + " " + inner.strip()
        if n.name == "item":
            return "-"
        return "" if n.name in ("cite", "citep", "citet", "label", "ref", "eqref", "pageref", "footnotemark", "index", "noindent", "par", "newpage", "centering") else inner
    if n.kind == "element":
        if n.name == "table":
            return _rows_to_table(_cells(text, n))
        if n.name in ("br", "tr"):
            return "\n" + inner
        if n.name == "hr":
            return "\n\n---\n\n"
        if n.name in ("script", "style", "head", "template", "ref", "references"):
            return ""
        if len(n.name) == 2 and n.name[0] == "h" and n.name[1].isdigit():
            return "#" * int(n.name[1]) + " " + " ".join(inner.split()) + "\n" if inner.strip() else ""
        if n.name in _EMPHASIS:
            return _wrap(_EMPHASIS[n.name], inner)
        if n.name == "li":
            return "\n- " + inner.strip()
        if n.name in ("ul", "ol", "menu", "dir"):
            if n.name == "ol":
                numbers = iter(range(1, 1 << 30))
                inner = re.sub(r"^- ", lambda _: f"{next(numbers)}. ", inner, flags=re.M)
            return "\n" + inner.strip("\n") + "\n"
        if n.name in ("pre", "listing", "xmp", "plaintext"):
            return "\n\n```\n" + inner.strip("\n") + "\n```\n\n"
        if n.name == "blockquote":
            return "\n\n" + "\n".join("> " + x for x in inner.strip().split("\n")) + "\n\n"
        if n.name in ("img", "image"):
            alt = re.search(r'alt\s*=\s*"([^"]*)"', raw)
            src = re.search(r'src\s*=\s*"([^"]*)"', raw)
            return f"![{alt.group(1) if alt else ''}]({src.group(1)})" if src else ""
        if n.name == "a" and inner:
            href = re.search(r"href\s*=\s*[\"']?([^\"'\s>]+)", raw)
            return f"[{inner}]({href.group(1)})" if href else inner
        if n.name in _BLOCK:
            return "\n\n" + inner.strip("\n") + "\n\n" if inner.strip() else ""
        return inner
    return inner or raw


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = trained()
    for b in batches:
        texts, tables = b.column("__text").to_pylist(), b.column("__table").to_pylist()
        counts, cleaned = [], []
        for t, k in zip(texts, tables):
            n = model.count(t, bool(k))
            counts.append(n)
            cleaned.append(model.clean(t, bool(k)) if n else t)
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(counts, pa.int32()), pa.array(cleaned, pa.string())], names=[*b.schema.names[:-2], "residue", "cleaned"])


def may_hold_markup(text: Column) -> Column:
    return text.rlike(TRIGGER)


def inspect(df: DataFrame, text: str, kind: str) -> DataFrame:
    """The columns of ``df`` but ``text`` and ``kind``, with ``residue`` (number of residue nodes) and ``cleaned`` (clean Markdown), for the
    rows whose text may hold markup. Texts of kind 'table' may be one HTML table as a whole. Null texts hold none."""
    ship(df.sparkSession)
    keys = [c for c in df.columns if c not in (text, kind)]
    src = df.where(may_hold_markup(F.col(text))).select(*keys, F.col(text).alias("__text"), F.coalesce(F.col(kind) == "table", F.lit(False)).alias("__table"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])
    return src.mapInArrow(_mark, f"{schema}, residue INT, cleaned STRING")


def _sources(out_items: DataFrame, blocks: DataFrame) -> DataFrame:
    md = out_items.select(F.lit("md").alias("field_name"), "book_id", "block_id", F.col("md").alias("text"), F.col("kind").alias("kind"))
    return md.union(blocks.select(F.lit("markdown"), "book_id", "block_id", "markdown", "block_type"))


def found(out_items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(field_name, book_id, block_id) of the texts with residue. Repeated rows count once."""
    return inspect(_sources(out_items, blocks), "text", "kind").where("residue > 0").select("field_name", "book_id", "block_id").distinct()


def clean(out_items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(field_name, book_id, block_id, text): every text as clean Markdown, one row for every row; null stays null."""
    rows = _sources(out_items, blocks)
    plain = rows.where(F.col("text").isNull() | ~may_hold_markup(F.col("text"))).select("field_name", "book_id", "block_id", "text")
    return plain.union(inspect(rows, "text", "kind").select("field_name", "book_id", "block_id", "cleaned"))
