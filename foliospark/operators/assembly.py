"""Assembly of chapters and books: Markdown, source maps, book files, inline marks, tables, scanned pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import tables as T
from foliospark.functions.text import anchor, fingerprint, yaml_quoted
from foliospark.operators.quality import CHAPTER, current_chapters
from foliospark.operators.structure import by_ord, with_paths

# Raised and lowered characters.
RAISED = ("0123456789+-=()ni−", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ⁻")
LOWERED = ("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")


def body(items: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, part): what of each item goes into the Markdown; a page comment where a page begins."""
    shown = items.where("md is not null and md <> '' and kind not in ('chapter_title', 'footnote')")
    new_page = ~F.lag("page").over(by_ord()).eqNullSafe(F.col("page")) | F.lag("ord").over(by_ord()).isNull()
    return shown.select(*CHAPTER, "ord", F.concat(F.when(new_page, F.concat(F.lit("<!-- source_page: "), "page", F.lit(" -->\n\n"))).otherwise(""), "md").alias("part"))


def contents(items: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """(book_id, chapter, toc): links to the headings of the second level, if there are at least three; the first thirty."""
    heads = items.where("kind = 'heading' and level = 2").select(*CHAPTER, "ord", F.regexp_extract("md", r"^#{1,6} ([^\n]*)", 1).alias("t"))
    heads = heads.withColumn("k", F.row_number().over(by_ord())).where(F.col("k") <= most)
    line = F.concat(F.lit("- ["), "t", F.lit("](#"), anchor(F.col("t")), F.lit(")"))
    lists = heads.groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("l")).where(F.size("l") >= least)
    return lists.select(*CHAPTER, F.concat(F.lit("## Contents\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n")).alias("toc"))


def chapter_markdown(items: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, chapter, markdown, sha256): each chapter with front matter, title, contents and body. Time stamps are left out, so that equal input
    gives equal output."""
    parts = body(items).groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    parts = parts.select(*CHAPTER, F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("body"))
    book = books.groupBy("book_id").agg(F.max_by(F.struct(F.col("title").alias("book_title"), "edition", "slug", "source_sha256"), "book_id").alias("b")).select("book_id", "b.*")
    rows = parts.join(current_chapters(chapters), CHAPTER).join(book, "book_id").join(contents(items), CHAPTER, "left")

    def quoted(c: Column) -> Column:
        return yaml_quoted(F.coalesce(c, F.lit("")))

    lines = F.array(
        F.lit("---"), F.concat(F.lit("book_title: "), quoted(F.col("book_title"))), F.concat(F.lit("edition: "), quoted(F.col("edition"))), F.concat(F.lit("chapter_number: "), "chapter"), F.concat(F.lit("chapter_title: "), quoted(F.col("title"))),
        F.concat(F.lit('source_pages: "'), "start_page", F.lit("-"), "end_page", F.lit('"')), F.lit('language: "en"'), F.lit('content_type: "textbook_chapter"'), F.concat(F.lit("source_sha256: "), quoted(F.col("source_sha256"))), F.lit("---"),
    )
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n<!-- section_id: "), "slug", F.lit("-ch"), "chapter", F.lit(" -->\n\n"), F.coalesce("toc", F.lit("")), "body", F.lit("\n"))
    return rows.select(*CHAPTER, text.alias("markdown"), F.sha2(text, 256).alias("sha256"))


def source_map(items: DataFrame) -> DataFrame:
    """One entry for each item: where it comes from, and hashes of what it holds."""
    rows = with_paths(items).where("md is not null and md <> ''")
    raw = F.coalesce("raw", F.lit(""))
    return rows.select(
        *CHAPTER, "ord", "block_id", F.col("kind").alias("type"), "section_id", F.col("page").alias("source_page"), *(F.bround(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")), "path",
        fingerprint(F.coalesce("cleaned", "md")).alias("fingerprint"), F.bround("confidence", 2).alias("confidence"), F.when(raw == "", "").otherwise(F.left(F.sha2(raw, 256), F.lit(12))).alias("raw_hash"),
    )


# Words for the statuses of chapters.
STATUS_WORDS = {"NOT_STARTED": "Not started", "PROCESSING": "Processing", "PARTIAL": "Partial", "COMPLETED": "Completed", "COMPLETED_WITH_WARNINGS": "Completed with warnings", "REVIEW_REQUIRED": "Review required", "FAILED": "Failed"}


def _chapters_of(chapters: DataFrame, status: DataFrame, files: DataFrame) -> DataFrame:
    """The chapters of each book with their status and Markdown file (null, if not converted). ``files``: (book_id, chapter, sha256) of the converted chapters."""
    rows = current_chapters(chapters).join(status, CHAPTER, "left").join(files.select(*CHAPTER, "sha256"), CHAPTER, "left").withColumn("status", F.coalesce("status", F.lit("NOT_STARTED")))
    return rows.withColumn("file", F.when(F.col("sha256").isNotNull(), F.format_string("chapters/ch_%03d.md", "chapter")))


def _book(books: DataFrame) -> DataFrame:
    return books.groupBy("book_id").agg(*(F.max(c).alias(c) for c in ("title", "edition", "slug", "source_sha256", "page_count"))).withColumnRenamed("title", "book_title")


def _listed(rows: DataFrame, line: Column) -> DataFrame:
    """(book_id, chapters, l): the lines of a book's chapters in their order."""
    lists = rows.groupBy("book_id").agg(F.count("*").alias("chapters"), F.array_sort(F.collect_list(F.struct("chapter", line.alias("line")))).alias("l"))
    return lists.select("book_id", "chapters", F.transform("l", lambda x: x["line"]).alias("l"))


def book_index(books: DataFrame, chapters: DataFrame, status: DataFrame, files: DataFrame, specialty: Column | None = None) -> DataFrame:
    """(book_id, chapters, page): the index page of each book, a row for each chapter, with a link to its file."""
    rows = _chapters_of(chapters, status, files)
    title = F.coalesce("title", F.lit(""))
    link = F.when(F.col("file").isNull(), "—").otherwise(F.concat(F.lit("["), F.element_at(F.split("file", "/"), -1), F.lit("]("), "file", F.lit(")")))
    named = F.when(F.col("file").isNull(), title).otherwise(F.concat(F.lit("["), title, F.lit("]("), "file", F.lit(")")))
    word = F.col("status")
    for k, v in STATUS_WORDS.items():
        word = F.when(F.col("status") == k, v).otherwise(word)
    line = F.format_string("| %d | %s | %s | %d–%d | %s | %s |", "chapter", named, F.coalesce(specialty if specialty is not None else F.lit(""), F.lit("")), "start_page", "end_page", link, word)
    head = F.concat(F.lit("# "), F.coalesce("book_title", F.lit("")), F.when(F.coalesce("edition", F.lit("")) != "", F.concat(F.lit(" — Edition "), "edition")).otherwise(""), F.lit("\n\n| Chapter | Title | Specialty | Source Pages | Markdown File | Conversion Status |\n|---|---|---|---|---|---|\n"))
    return _listed(rows, line).join(_book(books), "book_id").select("book_id", "chapters", F.concat(head, F.array_join("l", "\n"), F.lit("\n")).alias("page"))


def book_yaml(books: DataFrame, chapters: DataFrame, status: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, yaml): what is known of a book, and of each of its chapters."""
    def quoted(c: str | Column) -> Column:
        return yaml_quoted(F.coalesce(c, F.lit("")))

    rows = _chapters_of(chapters, status, files)
    line = F.format_string("  - number: %d\n    title: %s\n    pages: %s\n    status: %s", "chapter", quoted("title"), quoted(F.format_string("%d-%d", "start_page", "end_page")), "status")
    top = F.format_string("title: %s\nedition: %s\nsource_sha256: %s\npages: %s\nslug: %s\nchapters:\n", quoted("book_title"), quoted("edition"), quoted("source_sha256"), F.coalesce(F.col("page_count").cast("string"), F.lit("null")), quoted("slug"))
    return _listed(rows, line).join(_book(books), "book_id").select("book_id", F.concat(top, F.array_join("l", "\n"), F.lit("\n")).alias("yaml"))


def manifest(books: DataFrame, chapters: DataFrame, status: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, n_files, manifest): the chapters of a book and their files as JSON. Time stamps are left out, so that equal input gives equal output."""
    rows = _chapters_of(chapters, status, files)
    every = F.array_sort(F.collect_list(F.struct("chapter", "title", "start_page", "end_page", "status")))
    done = F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("chapter", "file", "sha256", "status"))))
    lists = rows.groupBy("book_id").agg(every.alias("chapters"), done.alias("chapter_files"))
    json = F.to_json(F.struct(F.col("book_title").alias("title"), "edition", "source_sha256", F.col("page_count").alias("pages"), "chapters", "chapter_files"), {"ignoreNullFields": "false"})
    return lists.join(_book(books), "book_id").select("book_id", F.size("chapter_files").alias("n_files"), json.alias("manifest"))


def readme(books: DataFrame) -> DataFrame:
    """(book_id, page): a page that says what is in the folder of a book and how it is written."""
    title = F.coalesce("book_title", F.lit(""))
    text = F.concat(
        F.lit("# "), title, F.lit(" — Markdown Knowledge Base\n\n- **Source book:** "), title, F.when(F.coalesce("edition", F.lit("")) != "", F.concat(F.lit(" (edition "), "edition", F.lit(")"))).otherwise(""), F.lit("\n- **Source SHA-256:** `"), F.coalesce("source_sha256", F.lit("")),
        F.lit("`\n\n| Path | What it holds |\n|---|---|\n| `00_BOOK_INDEX.md` | chapters and their status |\n| `book.yaml`, `manifest.json` | metadata |\n| `chapters/` | one Markdown file a chapter |\n| `tables/` | tables of more than 40 rows |\n| `source_maps/` | where each item comes from |\n"
              "| `indexes/` | generated navigation, not part of the book |\n| `rag/chunks.jsonl` | chunks for retrieval |\n| `reports/` | a report on each chapter |\n\nPages begin at `<!-- source_page: N -->`, sections at `<!-- section_id: ... -->`; reference entries carry `<a id=\"ref-N\">`.\n"),
    )
    return _book(books).select("book_id", text.alias("page"))


def memory(margins: DataFrame, bodies: DataFrame, heads: DataFrame) -> DataFrame:
    """(book_id, body_font_size, running_headers, levels_seen): what later conversions of a book may use."""
    m = margins.groupBy("book_id").agg(F.array_sort(F.collect_set("margin")).alias("running_headers"))
    h = heads.groupBy("book_id").agg(F.array_sort(F.collect_set("level")).alias("levels_seen"))
    rows = bodies.join(m, "book_id", "left").join(h, "book_id", "left")
    return rows.select("book_id", F.col("body").alias("body_font_size"), F.coalesce("running_headers", F.array().cast("array<string>")).alias("running_headers"), F.coalesce("levels_seen", F.array().cast("array<int>")).alias("levels_seen"))


def merge_memory(old: DataFrame, new: DataFrame) -> DataFrame:
    """The memory of a book after another conversion: all running headers ever seen, the rest as last found."""
    rows = new.alias("n").join(old.alias("o"), "book_id", "full")
    union = F.array_sort(F.array_union(F.coalesce("o.running_headers", F.array().cast("array<string>")), F.coalesce("n.running_headers", F.array().cast("array<string>"))))
    return rows.select("book_id", F.coalesce("n.body_font_size", "o.body_font_size").alias("body_font_size"), union.alias("running_headers"), F.coalesce("n.levels_seen", "o.levels_seen").alias("levels_seen"))


def raised(text: Column) -> Column:
    t = F.btrim(text)
    citation = t.rlike(r"^[0-9, –-]+$") & t.rlike("[0-9]") & ~t.rlike("^[0-9]$")
    return F.when(t == "", text).when(~citation & t.rlike("^[0-9+−=()ni-]+$"), F.translate(t, *RAISED)).otherwise(F.concat(F.lit("<sup>"), t, F.lit("</sup>")))


def lowered(text: Column) -> Column:
    t = F.btrim(text)
    return F.when(t == "", text).when(t.rlike(r"^[0-9+=()-]+$"), F.translate(t, *LOWERED)).otherwise(F.concat(F.lit("<sub>"), t, F.lit("</sub>")))


def inline_marks(spans: Column) -> Column:
    """Spans as Markdown: runs of one style in stars, raised and lowered spans in their characters. A fold over the spans of a line: finished
    text, the open run and its style; blanks belong to the open run."""
    none = F.lit(-1)

    def closed(run: Column, style: Column) -> Column:
        core = F.btrim(run)
        mark = F.when(style == 3, "***").when(style == 2, "**").when(style == 1, "*").otherwise("")
        at = F.call_function("instr", run, core)
        lead, trail = F.call_function("substring", run, F.lit(1), at - 1), F.call_function("substring", run, at + F.length(core))
        return F.when((core == "") | (mark == ""), run).otherwise(F.concat(lead, mark, core, mark, trail))

    def state(done: Column, run: Column, style: Column) -> Column:
        return F.struct(done.alias("done"), run.alias("run"), style.cast("int").alias("style"))

    def step(acc: Column, s: Column) -> Column:
        t = F.coalesce(s["text"], F.lit(""))
        sup, sub = F.coalesce(s["sup"], F.lit(False)), F.coalesce(s["sub"], F.lit(False))
        style = F.when(F.coalesce(s["bold"], F.lit(False)), 2).otherwise(0) + F.when(F.coalesce(s["italic"], F.lit(False)), 1).otherwise(0)
        flushed = F.concat(acc["done"], closed(acc["run"], acc["style"]))
        return (
            F.when(sup, state(F.concat(flushed, raised(t)), F.lit(""), none)).when(sub, state(F.concat(flushed, lowered(t)), F.lit(""), none)).when(F.btrim(t) == "", state(acc["done"], F.concat(acc["run"], t), acc["style"]))
            .when(acc["style"] == style, state(acc["done"], F.concat(acc["run"], t), acc["style"])).otherwise(state(flushed, t, style))
        )

    return F.aggregate(spans, state(F.lit(""), F.lit(""), none), step, lambda a: F.concat(a["done"], closed(a["run"], a["style"])))


def analysed_tables(blocks: DataFrame) -> DataFrame:
    """(book_id, block_id, page, rows, n_rows, n_cols, empty_ratio, ragged, multirow_header, complex, large): pipe tables of at least two rows and
    columns that hold anything; a second row that is mostly empty under an unfilled head is part of the head."""
    rows = blocks.where("block_type = 'table' and markdown is not null").select("book_id", "block_id", "page", T.rows_of_pipes(F.col("markdown")).alias("rows")).distinct()
    c = F.col("rows")
    rows = rows.where((F.size(c) >= 2) & (T.width(c) >= 2) & F.exists(F.flatten(c), lambda x: x != ""))
    second = F.get(c, F.lit(1))
    multi = (F.size(F.filter(second, lambda x: x == "")) > F.floor(F.size(second) / 2)) & (T.empty_headers(c) > 0)
    share = F.size(F.filter(F.flatten(c), lambda x: x == "")) / F.greatest(F.size(F.flatten(c)), F.lit(1))
    return rows.select("book_id", "block_id", "page", "rows", F.size(c).alias("n_rows"), T.width(c).alias("n_cols"), T.empty_ratio(c).alias("empty_ratio"), T.ragged(c).alias("ragged"), multi.alias("multirow_header"), (T.ragged(c) | multi | (share > 0.35) | (T.empty_headers(c) > 0)).alias("complex"), (F.size(c) > T.LARGE_ROWS).alias("large"))


def scanned_pages(pages: DataFrame, least_chars: int = 25) -> DataFrame:
    """Pages (native_chars, images) whose text has to be recognised: hardly any native text, and a picture or nothing at all."""
    return pages.where((F.col("native_chars") < least_chars) & ((F.col("images") > 0) | (F.col("native_chars") == 0)))


#: Makes words out of pictures of pages: (page rows with a picture) -> (book_id, page, block, par, line, word_no, text, conf). None is built in.
_recogniser: Callable[[DataFrame], DataFrame] | None = None


def set_recogniser(f: Callable[[DataFrame], DataFrame] | None) -> None:
    """Sets what recognises the text of scanned pages; None: they stay without a text."""
    global _recogniser
    _recogniser = f


def recognise(pages: DataFrame, least_chars: int = 25) -> DataFrame | None:
    """(book_id, page, text, confidence) of the pages whose text has to be recognised; None without a recogniser."""
    return None if _recogniser is None else recognised_lines(_recogniser(scanned_pages(pages, least_chars)))


def recognised_lines(words: DataFrame) -> DataFrame:
    """(book_id, page, text, confidence): recognised words (block, par, line, word_no, text, conf) as lines; words of negative confidence don't count."""
    ok = words.where("conf >= 0 and trim(text) <> ''")
    lines = ok.groupBy("book_id", "page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("t"))
    text = lines.groupBy("book_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return text.join(ok.groupBy("book_id", "page").agg(F.round(F.avg("conf") / 100, 4).alias("confidence")), ["book_id", "page"])


def export_files(files: DataFrame, mode: str, chapter: int | None = None, with_source: bool = False) -> DataFrame:
    """The files (path) of an export: 'all' without state folders and partial files, 'rag' the retrieval package, 'chapter' one chapter's."""
    p = F.col("path")
    if mode == "rag":
        return files.where(p.isin("rag/chunks.jsonl", "manifest.json", "book.yaml", "README.md"))
    if mode == "chapter":
        key = f"ch_{chapter:03d}"
        return files.where(p.rlike(rf"^(chapters/{key}_|assets/images/{key}/|tables/{key}/)") | p.isin(f"source_maps/{key}.json", f"reports/{key}_conversion_report.md"))
    kept = ~p.rlike(r"(^|/)\.") & ~p.rlike(r"(^|/)\.tmp_")
    return files.where(kept & (F.lit(with_source) | ~p.startswith("source/")))
