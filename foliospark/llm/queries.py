"""Queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    from foliospark.llm.tokens import encode

    return encode(table(spark, d, "documents"), ["doc_id"])


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a common run of at least 240 code points."""
    from foliospark.llm.spans import SharedSpans

    return SharedSpans(table(spark, d, "documents")).pairs()


@query
def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """Each document that shares a span, its class of copies, and how many of its characters are shared."""
    from foliospark.llm.spans import SharedSpans

    return SharedSpans(table(spark, d, "documents")).report().withColumnRenamed("id", "doc_id")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines and titles repeated excessively within a book."""
    from foliospark.llm.lines import found

    return found(table(spark, d, "page_lines"), table(spark, d, "chapters"))


@query
def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every line and title met in more than one page or chapter of a book, with its frequencies inside and outside, and whether it is in excess."""
    from foliospark.llm.lines import evidence, keyed_units, sources

    rows = evidence(keyed_units(sources(table(spark, d, "page_lines"), table(spark, d, "chapters"))))
    return rows.drop("a", "b").withColumn("decades", F.round("decades", 6))


@query
def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without their repeated lines."""
    from foliospark.llm.lines import clean_pages

    return clean_pages(table(spark, d, "page_lines"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans and cleaned texts that look like a glossary term but hold other characters."""
    from foliospark.llm.glyphs import found

    return found(table(spark, d, "page_lines"), table(spark, d, "blocks"), table(spark, d, "glossary"))


@query
def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned text of every block in its one form."""
    from foliospark.llm.glyphs import normalise

    return normalise(table(spark, d, "blocks").select("book_id", "block_id", "cleaned_text"), "cleaned_text", "form").drop("cleaned_text")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and blocks whose Markdown holds residue of other markup."""
    from foliospark.llm.markup import found

    return found(table(spark, d, "out_items"), table(spark, d, "blocks"))


@query
def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown of items and blocks without residue."""
    from foliospark.llm.markup import clean

    return clean(table(spark, d, "out_items"), table(spark, d, "blocks"))


ORACLES["p5_found"] = """with l as (select kind, min(max_chars) as m from split_limits group by 1), t as (select 'md' as field_name, book_id, block_id, md as text, kind from out_items union all select 'markdown', book_id, block_id, markdown, block_type from blocks)
select distinct field_name, book_id, block_id from t join l using (kind) where length(text) > m"""


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and blocks whose Markdown exceeds the limit of its kind."""
    from foliospark.llm.split import found

    return found(table(spark, d, "out_items"), table(spark, d, "blocks"), table(spark, d, "split_limits"))


@query
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown of items and blocks in pieces within their limits."""
    from foliospark.llm.split import pieces

    return pieces(table(spark, d, "out_items"), table(spark, d, "blocks"), table(spark, d, "split_limits"))


def _repair(spark: SparkSession, d: str):
    from foliospark.llm.ocr import Repair

    return Repair(table(spark, d, "blocks"), table(spark, d, "books"), table(spark, d, "chapters"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the texts of scanned blocks."""
    return _repair(spark, d).found()


@query
def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The raw text of scanned blocks as continuous paragraphs."""
    return _repair(spark, d).repaired()


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The copies of documents that make up the mixture, shuffled."""
    from foliospark.llm.mixing import Mixture

    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).copies()


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    from foliospark.llm.mixing import Mixture

    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()
