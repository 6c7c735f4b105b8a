"""One form for texts that look the same (problem 2), and line keys that build on it.

Method: the distinct texts that hold anything but plain ASCII are exploded to positioned code points (a run of plain ASCII stays one piece,
for it maps to itself); a broadcast join maps each code point to its decomposition in one script, width and kind of blank or hyphen;
combining marks are ordered by their class within their cluster; clusters are recomposed and the texts rebuilt by position.

The mapping has one row for each code point that Unicode decomposes or gives a combining class, so it's bounded by Unicode.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Letters of other scripts (Cyrillic, Greek, Armenian, Cherokee, phonetic) that look like a Latin letter, behind the letter they look like.
LOOK_ALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "Ꮐ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "ᏞԼ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ",
    "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "Ꮩ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝ",
    "x": "х", "y": "уүγ",
}
# Hyphens and dashes of the length of a hyphen.
HYPHENS = "‐‑‒–−﹘﹣－"
# Fillers and joiners that show nothing and aren't in the category of format characters.
FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"

_SCRIPT = {c: latin for latin, others in LOOK_ALIKES.items() for c in others}
_PLAIN = r"[ -~\n\r]"
#: An emoji with its joiners and selectors stays as it is; a plain run ends before a character that a mark or an invisible one follows. Han and Hangul map to
#: themselves like ASCII and stand in the same runs.
_PIECES = r"(?s)([\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}](?:[\x{FE0F}\x{1F3FB}-\x{1F3FF}]|\x{200D}[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}])*|[ -~\n\r\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]+(?![\p{M}\p{Cf}])|.)"


def _one(c: str) -> str:
    """What a code point becomes before marks are ordered."""
    category = unicodedata.category(c)
    if category == "Cf" or c in FILLERS or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if category in ("Zs", "Zl", "Zp") or c in "\t\x0b\x0c\x85":
        return " "
    if c in HYPHENS:
        return "-"
    kind, _, rest = unicodedata.decomposition(c).partition("> ")
    if rest and kind[1:] in ("wide", "narrow"):
        return "".join(_one(chr(int(x, 16))) for x in rest.split())
    parts = [chr(int(x, 16)) for x in rest.split()]
    if rest and kind[1:] == "font" and all(unicodedata.category(p)[0] in "LN" for p in parts):  # a letter or digit in another face
        return "".join(_one(p) for p in parts)
    if rest and kind[1:] == "compat" and (category == "Nl" or category[0] == "L" and len(parts) > 1):  # joined letters, Roman numerals
        if all(unicodedata.category(p)[0] == "L" for p in parts):
            return "".join(_one(p) for p in parts)
    return "".join(_SCRIPT.get(x, x) for x in unicodedata.normalize("NFD", c))


_EMOJI = re.compile("[\U0001F000-\U0001FAFF\u2600-\u27BF](?:[\uFE0F\U0001F3FB-\U0001F3FF]|\u200D[\U0001F000-\U0001FAFF\u2600-\u27BF])*")


def form_of(text: str) -> str:
    """The form of one text, for operators that have it in Python anyway; emoji stay as they are."""
    if text.isascii() and not _CONTROL.search(text):
        return text
    out, at = [], 0
    for m in _EMOJI.finditer(text):
        out += [unicodedata.normalize("NFC", "".join(map(_known_one, text[at : m.start()]))), m.group()]
        at = m.end()
    return "".join(out) + unicodedata.normalize("NFC", "".join(map(_known_one, text[at:])))


_CONTROL = re.compile(r"[\t\x0b\x0c]")
_known_one = lru_cache(1 << 16)(_one)


@lru_cache(1)
def mapping_rows() -> list[tuple[str, int, str, int]]:
    """(code point, number, part, combining class) for every code point that isn't its own form, and for every mark. Hangul stays."""
    rows = []
    for n in [9, 11, 12, *range(127, 0x30000), *range(0xE0000, 0xE01F0)]:
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        to = _one(c)
        if to != c or unicodedata.combining(c):
            rows += [(c, i, x, unicodedata.combining(x)) for i, x in enumerate(to)] or [(c, 0, "", 0)]
    return rows


@lru_cache(1)
def composition_rows() -> list[tuple[str, str]]:
    """(starter and ordered marks, composed code point) for every code point that canonical composition makes. Hangul stays."""
    rows = []
    for n in range(0xC0, 0x30000):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.normalize("NFC", c) == c and all(unicodedata.combining(x) for x in d[1:]):
            rows.append((d, c))
    return rows


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(mapping_rows(), "cp STRING, sub INT, part STRING, ccc INT")


def needs_mapping(text: Column) -> Column:
    """Whether a text holds anything but printable ASCII and line ends. Other texts are their own form."""
    return text.rlike(rf"[^{_PLAIN[1:-1]}]")


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("h2")]


def forms(texts: DataFrame, column: str = "text") -> DataFrame:
    """(h1, h2, text, form) for each distinct text of ``column`` that needs a mapping."""
    spark = texts.sparkSession
    text = F.col("text")
    distinct = texts.select(F.col(column).alias("text")).where(needs_mapping(text)).groupBy(*text_keys(text)).agg(F.first("text").alias("text"))
    pieces = distinct.select("h1", "h2", F.posexplode(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(1))).alias("pos", "cp"))
    parts = (
        pieces.join(F.broadcast(_mapping(spark)), "cp", "left")
        .select("h1", "h2", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("part", "cp").alias("part"), F.coalesce("ccc", F.lit(0)).alias("ccc"))
        .where("part <> ''")
    )
    order = Window.partitionBy("h1", "h2").orderBy("pos", "sub")
    clusters = parts.withColumn("cluster", F.sum((F.col("ccc") == 0).cast("int")).over(order))
    marks = F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "part")))
    clusters = clusters.groupBy("h1", "h2", "cluster").agg(F.transform(marks, lambda x: x["part"]).alias("m"))
    # The longest beginning of a cluster that composes is composed: read from the whole cluster down to its starter alone.
    tries = clusters.select("h1", "h2", "cluster", "m", F.explode(F.sequence(F.size("m"), F.lit(1), F.lit(-1))).alias("n"))
    tries = tries.withColumn("head", F.array_join(F.slice("m", 1, F.col("n")), ""))
    composed = spark.createDataFrame(composition_rows(), "head STRING, whole STRING")
    tries = tries.join(F.broadcast(composed), "head", "left").where("n = 1 or whole is not null")
    best = F.max_by(F.concat(F.coalesce("whole", "head"), F.array_join(F.expr("slice(m, n + 1, size(m))"), "")), "n")
    clusters = tries.groupBy("h1", "h2", "cluster").agg(best.alias("t"))
    built = clusters.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("cluster", "t"))).alias("all"))
    built = built.select("h1", "h2", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("form"))
    return distinct.join(built, ["h1", "h2"], "left").select("h1", "h2", "text", F.coalesce("form", F.lit("")).alias("form"))


def normalise(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the column ``out``: the text of ``column`` in its one form; null stays null, a text of invisible characters becomes ''."""
    text = F.col(column)
    cols = [F.col(f"`{c}`") for c in df.columns]
    plain = df.where(text.isNull() | ~needs_mapping(text)).select(*cols, text.alias(out))
    h1, h2 = (k.alias(f"__{n}") for k, n in zip(text_keys(text), ("h1", "h2")))
    other = df.where(needs_mapping(text)).select(*cols, h1, h2)
    f = forms(df, column).select(F.col("h1").alias("__f1"), F.col("h2").alias("__f2"), F.col("form").alias("__form"))
    other = other.join(f, (F.col("__h1") == F.col("__f1")) & (F.col("__h2") == F.col("__f2"))).select(*cols, F.col("__form").alias(out))
    return plain.unionByName(other)


def line_key(form: Column) -> Column:
    """What two equal lines have in common: the letters, in one case."""
    return F.lower(F.regexp_replace(form, r"[^\p{L}\p{M}]+", ""))


def look_like(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, text, form, term_id) of the distinct texts that look like a term but aren't equal to it; terms: (term_id, term)."""
    form = normalise(terms.select("term_id", "term"), "term", "form").withColumnRenamed("term", "__term")
    return forms(texts, text).join(form, "form").where("text <> __term").drop("__term")


def found(page_lines: DataFrame, blocks: DataFrame, glossary: DataFrame) -> DataFrame:
    """Spans and cleaned texts that look like a glossary term: (field_name, book_id, page, block_seq, term_id). Nulls and texts without
    anything but plain ASCII can't differ from a term that they look like; repeated rows count once."""
    spans = page_lines.select("book_id", "page", "block_seq", F.explode("spans").alias("s")).select(F.lit("span").alias("field_name"), "book_id", "page", "block_seq", F.col("s.text").alias("text"))
    cleaned = blocks.select(F.lit("cleaned_text").alias("field_name"), "book_id", "page", "block_seq", F.col("cleaned_text").alias("text"))
    rows = reduce(DataFrame.unionByName, [spans, cleaned]).where(needs_mapping(F.col("text")))
    hits = look_like(rows, glossary).select("h1", "h2", "term_id")
    rows = rows.select("field_name", "book_id", "page", "block_seq", *text_keys(F.col("text")))
    return rows.join(hits, ["h1", "h2"]).select("field_name", "book_id", "page", "block_seq", "term_id").distinct()
