"""Chunks for retrieval, term indexes and the book's memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import anchor, for_retrieval
from foliospark.operators.quality import CHAPTER, current_chapters
from foliospark.operators.structure import by_ord, with_paths

MAX_CHARS = 1800
# Endings and names of diseases, endings of drugs, words that aren't terms alone, symptoms.
DISEASE = r"\b([A-Z]?[a-z]+(?:itis|osis|emia|aemia|pathy|oma|plasia|penia|uria|algia)|[A-Z][a-z]+ (?:syndrome|disease|disorder|deficiency|anemia|fever))\b"
DRUG = r"(?i)\b([A-Za-z]+(?:mycin|cillin|cycline|azole|vir|statin|pril|sartan|olol|dipine|mab|floxacin|thiazide|prazole|setron|barbital|zepam|caine|parin|sone|solone))\b"
STOP = ["Syndrome", "Disease", "Disorder"]
SYMPTOMS = [
    "fever", "cough", "vomiting", "diarrhea", "rash", "pallor", "jaundice", "cyanosis", "dyspnea", "wheezing", "seizure", "headache", "lethargy", "irritability", "failure to thrive", "abdominal pain", "edema", "hepatomegaly",
    "splenomegaly", "tachycardia", "tachypnea", "hypotension", "fatigue", "dehydration", "apnea", "stridor", "hematuria", "bleeding", "bruising", "weight loss",
]


def sections(items: DataFrame) -> DataFrame:
    """items with ``path`` and ``section``: a running number of sections, each begun by a heading or another section id."""
    rows = with_paths(items).where("md is not null and kind not in ('chapter_title', 'footnote')")
    begins = (F.col("kind") == "heading") | (F.lag("section_id").over(by_ord()).eqNullSafe(F.col("section_id")) == F.lit(False)) | F.lag("ord").over(by_ord()).isNull()
    rows = rows.withColumn("begins", begins.cast("int"))
    return rows.withColumn("section", F.sum("begins").over(by_ord()))


def chunks(items: DataFrame, longest: int = MAX_CHARS) -> DataFrame:
    """(book_id, chapter, section, chunk, section_id, path, pages, ords, refs, content_type, n_chars, text): items of a section packed while their
    lengths add up to ``longest``; one longer than that stands alone. Packing is a fold with resets over a section, so a section is the unit."""
    rows = sections(items).where("kind <> 'heading'").withColumn("t", for_retrieval(F.col("md"))).where("t <> ''")
    parts = rows.groupBy(*CHAPTER, "section").agg(F.array_sort(F.collect_list(F.struct("ord", F.length("t").alias("n"), "t", "page", "kind"))).alias("p"), F.min_by("section_id", "ord").alias("section_id"), F.min_by("path", "ord").alias("path"))
    kind = "array<struct<chunk:int,ord:int>>"
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.array().cast(kind).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["chunk"] == 0) | (acc["size"] + x["n"] > longest)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["n"]).otherwise(acc["size"] + x["n"]).alias("size"), F.concat(acc["at"], F.array(F.struct(chunk.alias("chunk"), x["ord"].alias("ord")))).alias("at"))

    placed = parts.withColumn("at", F.aggregate("p", start, step, lambda a: a["at"]))
    rows = placed.select(*CHAPTER, "section", "section_id", "path", F.explode(F.zip_with("p", "at", lambda p, a: F.struct(a["chunk"].alias("chunk"), p["ord"].alias("ord"), p["n"].alias("n"), p["t"].alias("t"), p["page"].alias("page"), p["kind"].alias("kind")))).alias("x")).select(*CHAPTER, "section", "section_id", "path", "x.*")
    packed = rows.groupBy(*CHAPTER, "section", "chunk").agg(
        F.first("section_id").alias("section_id"), F.first("path").alias("path"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_list("ord")).alias("ords"), F.sum("n").alias("n_chars"),
        F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("texts"), F.bool_and(F.col("kind") == "reference").alias("all_refs"), F.bool_and(F.col("kind") == "table").alias("all_tables"),
    )
    body = F.array_join(F.transform("texts", lambda x: x["t"]), "\n\n")
    refs = F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))), 1, 50)
    text = F.when(F.size("path") > 0, F.concat(F.array_join("path", " > "), F.lit("\n\n"), body)).otherwise(body)
    content = F.when(F.col("all_refs"), "reference").when(F.col("all_tables"), "table").otherwise("text")
    return packed.select(*CHAPTER, "section", "chunk", "section_id", "path", "pages", "ords", refs.alias("refs"), content.alias("content_type"), "n_chars", text.alias("text"))


_PLACE = ["chapter", "chapter_title", "section_id", "heading"]


def index_places(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter, chapter_title, section_id, heading, title, text): the items with where they stand: their section, its heading or else the
    chapter's title; title: of a section, for the item that begins it."""
    rows = with_paths(items).where("md is not null").join(current_chapters(chapters).select(*CHAPTER, F.coalesce("title", F.lit("")).alias("chapter_title")), CHAPTER, "left")
    chapter_title = F.coalesce("chapter_title", F.lit(""))
    heading = F.coalesce(F.get("path", F.size("path") - 1), chapter_title)
    own = F.when(F.col("kind") == "heading", F.regexp_extract("md", r"^#{1,6} ([^\n]*)", 1))
    return rows.select(*CHAPTER, chapter_title.alias("chapter_title"), F.coalesce("section_id", F.lit("")).alias("section_id"), heading.alias("heading"), own.alias("title"), for_retrieval(F.col("md")).alias("text"))


def index_terms(places: DataFrame) -> DataFrame:
    """(book_id, category, term, chapter, chapter_title, section_id, heading): diseases, drugs, symptoms and topics and the sections they stand in. Words are
    parted where a letter, digit or underscore meets anything else; symptoms are looked for anywhere in a text, also inside words; topics are the
    titles of the sections. ``places`` as ``index_places`` gives them. One pass: each text gives its terms as one array."""
    def terms(category: str, words: Column) -> Column:
        return F.transform(words, lambda w: F.struct(F.lit(category).alias("category"), w.alias("term")))

    text, low = F.col("text"), F.lower("text")
    found = F.filter(F.regexp_extract_all(text, F.lit(DISEASE), F.lit(1)), lambda w: (F.length(w) > 5) & ~w.isin(STOP))
    drugs = F.transform(F.regexp_extract_all(text, F.lit(DRUG), F.lit(1)), F.lower)
    seen = F.filter(F.array(*(F.lit(w) for w in SYMPTOMS)), lambda w: F.contains(low, w))
    topics = F.when(F.coalesce("title", F.lit("")) != "", F.array("title")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(terms("diseases", found), terms("drugs", drugs), terms("signs_symptoms", seen), terms("topics", topics)))
    return places.select("book_id", *_PLACE, F.explode(every).alias("x")).select("book_id", "x.category", "x.term", *_PLACE).distinct()


def index_lines(terms: DataFrame, most: int = 8) -> DataFrame:
    """(book_id, category, term, place, n, line): the lines of the navigation indexes: each term and its first sections, with dots if there are more;
    place: of the line in its index, by the term without regard to case."""
    k = F.row_number().over(Window.partitionBy("book_id", "category", "term").orderBy(*_PLACE))
    file = F.format_string("chapters/ch_%03d.md", "chapter")
    link = F.concat(F.lit("[Ch "), "chapter", F.lit(": "), "heading", F.lit("]("), file, F.lit("#"), anchor(F.col("heading")), F.lit(")"))
    rows = terms.withColumn("k", k).groupBy("book_id", "category", "term").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", link.alias("link"))))).alias("l"))
    line = F.concat(F.lit("- **"), "term", F.lit("** — "), F.array_join(F.transform("l", lambda x: x["link"]), "; "), F.when(F.col("n") > most, " …").otherwise(""))
    place = F.row_number().over(Window.partitionBy("book_id", "category").orderBy(F.lower("term"), "term"))
    return rows.select("book_id", "category", "term", place.alias("place"), "n", line.alias("line"))


# The names of the indexes, and what stands above each.
INDEX_TITLES = {"diseases": "Diseases", "drugs": "Drugs", "signs_symptoms": "Signs & Symptoms", "topics": "Topics"}
INDEX_HEADER = (
    "> **Generated navigation index — not part of the original textbook.**\n> Entries link to the chapter and section where the term appears. No factual text is added.\n\n"
    "_Method: deterministic pattern matching. Verify in the chapter text._\n\n"
)


def index_pages(lines: DataFrame) -> DataFrame:
    """(book_id, category, page): the index pages, with their lines in order."""
    title = F.lit(None).cast("string")
    for k, v in INDEX_TITLES.items():
        title = F.when(F.col("category") == k, v).otherwise(title)
    rows = lines.groupBy("book_id", "category").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    return rows.select("book_id", "category", F.concat(F.lit("# "), title, F.lit(" Index\n\n"), F.lit(INDEX_HEADER), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("page"))
