"""Scalar text functions as native columns. Character classes are written out, since Java, RE2 and Python differ in what \\s and \\w hold."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space, ligatures, characters without width, blanks that aren't the usual one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
NO_WIDTH = "\u200b\u200c\u200d\ufeff\xad"
BLANKS = "\xa0\u2009\u202f"
SECTION_GLYPH = "␣"
# Words that a lost letter of a "Th" ligature leaves, and the words meant.
LOST_H = {
    "Te": "The", "Tey": "They", "Tem": "Them", "Tis": "This", "Tat": "That", "Tese": "These", "Tose": "Those", "Tere": "There", "Tus": "Thus",
    "Terefore": "Therefore", "Terapy": "Therapy", "Terapeutic": "Therapeutic", "Tird": "Third", "Trombocytopenia": "Thrombocytopenia", "Tyroid": "Thyroid",
}
# Forms of numbers, doses, words.
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
DOSE = r"(?i)[0-9]+(?:\.[0-9]+)? ?(?:mg|mcg|µg|μg|g|kg|mL|ml|L|IU|U|units?|mmol|mEq|mmHg|%|°C|bpm)\b"
WORD = r"[A-Za-z]{3,}"


def normalize_chars(text: Column) -> Column:
    """Ligatures spelled out, characters without width dropped, blanks made plain."""
    for lig, plain in LIGATURES.items():
        text = F.replace(text, F.lit(lig), F.lit(plain))
    return F.translate(text, BLANKS + NO_WIDTH, " " * len(BLANKS))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize_ws(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def drop_section_glyph(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "*" + SECTION_GLYPH, "")


def margin_key(text: Column) -> Column:
    """What repeated margin lines have in common: numbers as #, lower case."""
    return F.lower(F.regexp_replace(normalize_ws(normalize_chars(text)), "[0-9]+", "#"))


def is_page_number(text: Column) -> Column:
    return text.rlike(r"(?i)^[ \t\n]*(?:page[ \t\n]*)?[0-9]{1,5}[ \t\n]*$")


def junk_share(text: Column) -> Column:
    """Share of control, private and replacement characters among those that aren't blank; null without any."""
    solid = F.regexp_replace(text, SPACE_CLASS, "")
    bad = F.regexp_count(solid, F.lit(r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F8FF}\x{FFFD}]"))
    return bad / F.nullif(F.length(solid), F.lit(0))


def fingerprint(text: Column) -> Column:
    return F.left(F.sha2(F.lower(strip(F.regexp_replace(text, SPACE_CLASS + "+", " "))), 256), F.lit(16))


def slug(ascii_text: Column, longest: int = 60) -> Column:
    """Slug of a text whose characters are already plain; others are dropped."""
    plain = F.regexp_replace(ascii_text, r"[^\x{0}-\x{7F}]", "")
    s = F.lower(F.btrim(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    s = F.btrim(F.left(s, F.lit(longest)), F.lit("-"))
    return F.when(s == "", F.lit("untitled")).otherwise(s)


@F.pandas_udf(StringType())
def decompose(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has none of its own."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def anchor(text: Column) -> Column:
    """Heading anchor as Git hosts build it."""
    return F.replace(strip(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\- ]", "")), F.lit(" "), F.lit("-"))


def without_comments(md: Column) -> Column:
    return F.regexp_replace(md, r"(?s)<!--.*?-->", "")


def for_retrieval(md: Column) -> Column:
    """Markdown without comments and anchors."""
    return strip(F.regexp_replace(without_comments(md), r'<a id="[^"]*"></a>', ""))


def table_words(md: Column) -> Column:
    return F.regexp_replace(md, r"<[^>]+>|\|", " ")


def yaml_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def number_tokens(text: Column) -> Column:
    """Numbers as written, thousands commas dropped; comments, tags, images, link targets and footnote marks don't count."""
    text = F.translate(text, "−–—", "---")
    for pattern, by in ((r"(?s)<!--.*?-->", " "), (r"</?[A-Za-z][^<>]*>", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\]\([^)]*\)", "]"), (r"\[\^[0-9]+\]", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))


def word_tokens(text: Column) -> Column:
    for pattern in (r"(?s)<!--.*?-->", r"!\[[^\]]*\]\([^)]*\)", r"</?[A-Za-z][^<>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def doses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DOSE), F.lit(0))


def restore_lost_h(text: Column) -> Column:
    for seen, meant in LOST_H.items():
        text = F.regexp_replace(text, rf"\b{seen}\b", meant)
    return text


def clean_title(title: Column) -> tuple[Column, Column]:
    """(number or null, title) of a chapter title that may begin with its number."""
    t = strip(F.regexp_replace(title, SPACE_CLASS + "+", " "))
    named = r"(?i)^(?:chapter|ch\.?) ([0-9]{1,4})\b[ .:\-–—]*(.*)$"
    plain = r"^([0-9]{1,4}) ?[.:\-–—]? +(.+)$"
    rest = F.btrim(F.regexp_extract(t, named, 2), F.lit(" .:-–—"))
    number = F.when(t.rlike(named), F.regexp_extract(t, named, 1)).when(t.rlike(plain), F.regexp_extract(t, plain, 1)).try_cast("int")
    return number, F.when(t.rlike(named), F.when(rest == "", t).otherwise(rest)).when(t.rlike(plain), strip(F.regexp_extract(t, plain, 2))).otherwise(t)


# Fixed value: the visible page label.
PAGE_LABEL = r"> **[Trang gốc: $1]**"


def view_mode(md: Column, mode: str) -> Column:
    """'source': page comments as visible labels; 'obsidian': quoted callouts as callout blocks of note editors; else as it is."""
    if mode == "source":
        return F.regexp_replace(md, r"<!--[\t-\r ]*source_page:[\t-\r ]*([0-9]+)[\t-\r ]*-->", PAGE_LABEL)
    if mode == "obsidian":
        for name in ("KEY POINTS", "KEY POINT", "CLINICAL PEARLS", "CLINICAL PEARL", "IMPORTANT", "SUMMARY", "CONTROVERSIES", "WARNING", "NOTE"):
            md = F.regexp_replace(md, rf"(?m)^> \*\*{name}\*\*", f"> [!{name.split()[0].lower()}] {name}")
    return md
