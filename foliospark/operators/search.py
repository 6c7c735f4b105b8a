"""Full-text search: an inverted index as two tables, ranking, phrases, filters and snippets."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliospark.functions.text import for_retrieval, table_words
from foliospark.session import ensure_checkpoint_dir, ship

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters with accents and the letters without, behind them the combining marks, which go."""
    folded = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
    folded = {c: d[0] for c, d in folded.items() if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) and c == c.lower()}
    return "".join(folded) + "".join(chr(c) for c in range(0x300, 0x370)), "".join(folded.values())


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), *_accents()), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def plain_word(word: str) -> str:
    """A word of a query as ``tokens`` has it."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


_VOWEL = "[aeiouy]"


def stem(word: str) -> str:
    """The published suffix-stripping algorithm of Porter (1980), in terms of the measure of a stem."""

    def cons(w: str, i: int) -> bool:
        c = w[i]
        return c not in "aeiou" and not (c == "y" and i > 0 and cons(w, i - 1))

    def measure(w: str) -> int:
        form = "".join("c" if cons(w, i) else "v" for i in range(len(w)))
        return len(re.findall("v+c+", form))

    def vowel(w: str) -> bool:
        return any(not cons(w, i) for i in range(len(w)))

    def cvc(w: str) -> bool:
        return len(w) > 2 and cons(w, len(w) - 1) and not cons(w, len(w) - 2) and cons(w, len(w) - 3) and w[-1] not in "wxy"

    def replace(w: str, table: dict[str, str], least: int) -> str:
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                base = w[: len(w) - len(end)]
                return base + table[end] if measure(base) > least else w
        return w

    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: len(w) - len(end)]):
                w = w[: len(w) - len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffixes of steps 2, 3 and 4.
    w = replace(w, {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}, 0)
    w = replace(w, {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}, 0)
    ends = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
    for end in sorted(ends, key=len, reverse=True):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    return words.map(stem)


class Index:
    """Full-text search over ``docs``: rows with the columns ``key`` and ``text``; null texts have no terms.

    Without a saved index one pass over the texts counts what a query asks for, document by document; nothing is shuffled. A saved index is two
    tables: postings (term, key..., len, tf, places), sorted by term, so that a query reads no others; and the documents' number and lengths
    for each ``unit`` of the key (a chapter), by which parts of the index are replaced. A replaced unit is written as a new segment, and the
    latest segment of a unit holds.

    stemmed: words are met in any form. Only the distinct words are stemmed."""

    def __init__(self, docs: DataFrame, key: list[str], text: str, stemmed: bool = False):
        if stemmed:
            ship(docs.sparkSession)
        self.key, self.stemmed = key, stemmed
        self.docs = docs.withColumn("t", tokens(F.col(text)))
        self._saved: tuple[DataFrame, DataFrame] | None = None

    @property
    def postings(self) -> DataFrame:
        if self._saved:
            return self._saved[0]
        rows = self.docs.select(*self.key, F.size("t").alias("len"), F.posexplode("t").alias("pos", "term"))
        return rows.groupBy("term", *self.key, "len").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("places"))

    def save(self, folder: str, unit: list[str] | None = None, segment: int = 0) -> None:
        """Writes the index, or, with a later segment, the units that these documents belong to anew. An empty ``unit`` is the whole index."""
        unit = unit or []
        how = "append" if segment else "overwrite"
        postings = self.postings.withColumn("segment", F.lit(segment))
        postings.repartitionByRange("term").sortWithinPartitions("term", *self.key).write.mode(how).parquet(f"{folder}/postings")
        units = self.docs.groupBy(*unit).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("total"), F.count("t").alias("n_texts"))
        units.withColumn("segment", F.lit(segment)).write.mode(how).parquet(f"{folder}/units")

    def load(self, folder: str, unit: list[str] | None = None) -> "Index":
        spark, unit = self.docs.sparkSession, unit or []
        units = spark.read.parquet(f"{folder}/units").groupBy(*unit).agg(F.max_by(F.struct("segment", "n_docs", "total", "n_texts"), "segment").alias("u")).select(*unit, "u.*")
        postings = spark.read.parquet(f"{folder}/postings")
        if unit:
            postings = postings.join(units.select(*unit, "segment"), [*unit, "segment"], "left_semi")
        self._saved = postings.drop("segment"), units
        return self

    def _terms(self, query: str) -> list[list[str]]:
        """Each quoted phrase or word of a query as its tokens; all must be met. A word with a hyphen is a phrase."""
        query = query.strip()
        parts = [query[1:-1]] if len(query) > 2 and query[0] == query[-1] == '"' else re.findall(r"[\w\-]+", query)
        out = [re.findall(r"[^\W_]+", plain_word(p)) for p in parts]
        return [[stem(w) for w in p] if self.stemmed else p for p in out if p]

    def _forms(self, words: list[str]) -> Column:
        """The words of the texts that are forms of ``words``, as a map to them: a row of its own, worked out from the distinct words."""
        terms = self._saved[0].select("term") if self._saved else self.docs.select(F.explode("t").alias("term"))
        hits = terms.distinct().select("term", stem_of("term").alias("stem")).where(F.col("stem").isin(words))
        return hits.agg(F.map_from_entries(F.collect_list(F.struct("term", "stem")))).scalar()

    def _rows(self, parts: list[list[str]]) -> DataFrame:
        """(key..., len, tf0, tf1...): how often each part of the query stands in a document: all documents, or those of a saved index that hold any."""
        words = sorted({w for p in parts for w in p})
        if self._saved:
            postings = self.postings
            if self.stemmed:
                forms = self._forms(words)
                postings = postings.withColumn("term", F.try_element_at(forms, F.col("term"))).where("term is not null")
                postings = postings.groupBy("term", *self.key, "len").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
            rows = postings.where(F.col("term").isin(words)).groupBy(*self.key, "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))

            def frequency(p: list[str]) -> Column:
                places = [F.coalesce(F.try_element_at("m", F.lit(w)), F.array().cast("array<int>")) for w in p]
                return F.size(F.filter(places[0], lambda x: reduce(lambda a, b: a & b, (F.array_contains(c, x + k) for k, c in enumerate(places[1:], 1)), F.lit(True))))

            return rows.select(*self.key, "len", *(frequency(p).alias(f"tf{i}") for i, p in enumerate(parts)))
        docs, t = self._read(words)

        def count(p: list[str]) -> Column:
            """How often the words of a phrase stand one behind the other."""
            if len(p) == 1:
                return F.size(F.filter(t, lambda x: x == p[0]))
            return F.size(F.filter(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["x"] == p[0]) & reduce(lambda a, b: a & b, (F.get(t, s["i"] + k) == w for k, w in enumerate(p[1:], 1)))))

        return docs.select(*self.key, F.size("t").alias("len"), *(F.coalesce(count(p), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(parts)))

    def _read(self, words: list[str]) -> tuple[DataFrame, Column]:
        """The documents, and the words of a text as the query has them; in a stemmed index null for all that it doesn't ask for."""
        if not self.stemmed:
            return self.docs, F.col("t")
        return self.docs.withColumn("__forms", self._forms(words)), F.transform("t", lambda x: F.try_element_at("__forms", x))

    def match(self, query: str, where: Column | None = None) -> DataFrame:
        """(key..., score): documents that hold all parts of the query, by BM25; less is better, as engines with negated scores have it. ``where`` is
        a condition on the documents' columns; it doesn't change the scores."""
        parts = self._terms(query)
        if not parts:
            return self.docs.select(*self.key, F.lit(0.0).alias("score")).where("false")
        ensure_checkpoint_dir(self.docs.sparkSession)
        hits = self._rows(parts).checkpoint()
        all_docs = self._saved[1].agg(F.sum("n_docs").alias("n"), (F.sum("total") / F.nullif(F.sum("n_texts"), F.lit(0))).alias("average")) if self._saved else hits.agg(F.count("*").alias("n"), F.avg("len").alias("average"))
        facts = hits.agg(F.struct(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(parts))))).scalar()
        size = all_docs.select(F.struct("n", "average")).scalar()
        score = F.lit(0.0)
        for i in range(len(parts)):
            found, tf = facts[f"df{i}"], F.col(f"tf{i}")
            idf = F.log((size["n"] - found + 0.5) / (found + 0.5))
            idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
            score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / size["average"]))
        all_met = reduce(lambda a, b: a & b, (F.col(f"tf{i}") > 0 for i in range(len(parts))))
        rows = hits.where(all_met).select(*self.key, F.round(score, 9).alias("score"))
        return rows if where is None else rows.join(self.docs.where(where).select(*self.key), self.key, "left_semi")

    def top(self, query: str, k: int = 30, where: Column | None = None) -> DataFrame:
        return self.match(query, where).orderBy("score", *self.key).limit(k)

    def snippets(self, query: str, width: int = 24, k: int = 30) -> DataFrame:
        """The best hits with ``snippet``: a window of tokens around the first one met, hits in double brackets."""
        words = sorted({w for p in self._terms(query) for w in p})
        docs, t = self._read(words)
        rows = docs.join(self.top(query, k), self.key)
        met = F.transform(t, lambda x: F.coalesce(F.array_contains(F.array(*(F.lit(w) for w in words)), x), F.lit(False)))
        rows = rows.withColumn("w", F.zip_with("t", met, lambda x, hit: F.when(hit, F.concat(F.lit("[["), x, F.lit("]]"))).otherwise(x))).withColumn("first", F.array_position(met, True) - 1)
        start = F.greatest(F.lit(0), F.least(F.col("first") - width // 4, F.size("t") - width)).cast("int")
        text = F.concat(F.when(start > 0, "… ").otherwise(""), F.array_join(F.slice("w", start + 1, width), " "), F.when(start + width < F.size("t"), " …").otherwise(""))
        return rows.select(*self.key, "score", text.alias("snippet"))


def only(chapter: int | None = None, kind: str | None = None, specialty: str | None = None) -> Column:
    """A condition on documents: of a chapter, of a kind, with a specialty that holds the text."""
    out = F.lit(True)
    if chapter is not None:
        out = out & (F.col("chapter") == chapter)
    if kind:
        out = out & (F.col("kind") == kind)
    if specialty:
        out = out & F.contains("specialty", F.lit(specialty))
    return out


def searchable(items: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, kind, text): what of the items is searched."""
    text = for_retrieval(F.when(F.col("kind") == "table", table_words(F.col("md"))).otherwise(F.col("md")))
    return items.where("md is not null").select("book_id", "chapter", "ord", "kind", text.alias("text")).where("text <> ''")
