"""Checks of converted text against its source: numbers, words, citations, completeness, headings; issues and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.references import cited_ranges, explode_range, prose
from foliospark.functions.text import doses, number_tokens, word_tokens

CHAPTER = ["book_id", "chapter"]


def chapter_of(block_id: Column) -> Column:
    return F.regexp_extract(block_id, r"^ch([0-9]+)-", 1).try_cast("int")


def sources(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter, block_id, page, text) of the blocks, repeated rows once; partitioned by chapter, as counts per chapter need it."""
    rows = blocks.where("raw_text is not null").select("book_id", chapter_of(F.col("block_id")).alias("chapter"), "block_id", "page", F.col("raw_text").alias("text"))
    return rows.repartition(*CHAPTER).distinct()


def outputs(out_items: DataFrame) -> DataFrame:
    return out_items.where("md is not null").select("book_id", "chapter", "ord", "kind", "page", F.col("md").alias("text")).repartition(*CHAPTER).distinct()


def bag(rows: DataFrame, tokens: Column, name: str) -> DataFrame:
    """(book_id, chapter, token, n): how often each token occurs in a chapter."""
    return rows.select(*CHAPTER, F.explode(tokens).alias("token")).groupBy(*CHAPTER, "token").agg(F.count("*").alias(name))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both bags side by side, 0 where a token is absent: (book_id, chapter, token, n_src, n_out)."""
    joined = a.join(b, [*CHAPTER, "token"], "full")
    return joined.select(*CHAPTER, "token", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_src", "n_out")))


def numeric_diff(blocks: DataFrame, out_items: DataFrame) -> DataFrame:
    """(book_id, chapter, token, n, code, severity): numbers that got lost or came in. A lost number that begins a dose is severe."""
    src, out = sources(blocks), outputs(out_items)
    diff = bag_difference(bag(src, number_tokens(F.col("text")), "n_src"), bag(out, number_tokens(F.col("text")), "n_out")).where("n_src <> n_out")
    dosed = src.select(*CHAPTER, F.explode(doses(F.col("text"))).alias("dose")).groupBy(*CHAPTER).agg(F.collect_set("dose").alias("doses"))
    lost = F.col("n_src") > F.col("n_out")
    begins = F.exists("doses", lambda x: F.rlike(x, F.concat(F.lit(r"(?:^|[^0-9.])"), F.replace("token", F.lit("."), F.lit("\\.")))))
    severity = F.when(~lost | F.coalesce(begins, F.lit(False)), "HIGH").otherwise("MEDIUM")
    return diff.join(dosed, CHAPTER, "left").select(*CHAPTER, "token", F.abs(F.col("n_src") - F.col("n_out")).alias("n"), F.when(lost, "MISSING_NUMBER").otherwise("UNEXPECTED_NUMBER").alias("code"), severity.alias("severity"))


def changed_numbers(diff: DataFrame, most: int = 5) -> DataFrame:
    """(book_id, chapter, severity, code, message): a changed number looks like one missing and one unexpected, so chapters with both are named, with the
    first of each. ``diff`` as ``numeric_diff`` gives it."""
    def first(code: str) -> Column:
        return F.slice(F.array_sort(F.collect_set(F.when(F.col("code") == code, F.col("token")))), 1, most)

    rows = diff.groupBy(*CHAPTER).agg(first("MISSING_NUMBER").alias("missing"), first("UNEXPECTED_NUMBER").alias("unexpected")).where("size(missing) > 0 and size(unexpected) > 0")
    message = F.concat(F.lit("missing "), F.array_join("missing", ", "), F.lit(" / unexpected "), F.array_join("unexpected", ", "))
    return rows.select(*CHAPTER, F.lit("HIGH").alias("severity"), F.lit("CHANGED_NUMBER").alias("code"), message.alias("message"))


def word_recall(blocks: DataFrame, out_items: DataFrame) -> DataFrame:
    """(book_id, chapter, lost, total, ratio, severity): share of source words that the output lacks."""
    diff = bag_difference(bag(sources(blocks), word_tokens(F.col("text")), "n_src"), bag(outputs(out_items), word_tokens(F.col("text")), "n_out"))
    sums = diff.groupBy(*CHAPTER).agg(F.sum(F.greatest(F.col("n_src") - F.col("n_out"), F.lit(0))).alias("lost"), F.sum("n_src").alias("total"))
    ratio = F.col("lost") / F.greatest("total", F.lit(1))
    return sums.select(*CHAPTER, "lost", "total", F.round(ratio, 6).alias("ratio"), F.when(ratio > 0.05, "CRITICAL").when(ratio > 0.01, "HIGH").otherwise("NONE").alias("severity"))


def reconcile_split_words(diff: DataFrame) -> DataFrame:
    """(book_id, chapter, freed, lost): missing words after words divided in the source are matched with the whole words of the output. A word only in
    the output takes back one missing word that it begins with and one that it ends in, at its first cut of which both are missing. A missing word is
    taken back as often as it is missing, for the first words in alphabetical order. Only words of different counts travel."""
    gaps = diff.where("n_src <> n_out").select(*CHAPTER, "token", (F.col("n_src") - F.col("n_out")).alias("gap"))
    missing = gaps.where("gap > 0")
    whole = gaps.where((F.col("gap") < 0) & (F.length("token") >= 6)).select(*CHAPTER, F.col("token").alias("word"))
    cuts = whole.withColumn("cut", F.explode(F.sequence(F.lit(3), F.length("word") - 3)))
    cuts = cuts.withColumn("l", F.left("word", F.col("cut"))).withColumn("r", F.substr("word", F.col("cut") + 1))
    both = cuts.join(missing.toDF(*CHAPTER, "l", "gap_l"), [*CHAPTER, "l"]).join(missing.toDF(*CHAPTER, "r", "gap_r"), [*CHAPTER, "r"])
    first = both.groupBy(*CHAPTER, "word").agg(F.min_by(F.struct("l", "r", "gap_l", "gap_r"), "cut").alias("x")).select(*CHAPTER, "word", "x.*")
    parts = first.select(*CHAPTER, "word", F.explode(F.array(F.struct(F.col("l").alias("part"), F.col("gap_l").alias("gap"), F.lit(1).alias("side")), F.struct(F.col("r").alias("part"), F.col("gap_r").alias("gap"), F.lit(2).alias("side")))).alias("p")).select(*CHAPTER, "word", "p.*")
    rank = F.row_number().over(Window.partitionBy(*CHAPTER, "part").orderBy("word", "side"))
    taken = parts.withColumn("fits", (rank <= F.col("gap")).cast("int")).groupBy(*CHAPTER, "word").agg(F.min("fits").alias("fits")).groupBy(*CHAPTER).agg((2 * F.sum("fits")).alias("freed"))
    lost = gaps.groupBy(*CHAPTER).agg(F.sum(F.greatest("gap", F.lit(0))).alias("missing")).join(taken, CHAPTER, "left").withColumn("freed", F.coalesce("freed", F.lit(0)))
    return lost.select(*CHAPTER, "freed", (F.col("missing") - F.col("freed")).alias("lost"))


def citation_check(out_items: DataFrame) -> DataFrame:
    """(book_id, chapter, code, n): cited numbers without an entry, entries never cited if more than half, citations without any list."""
    items = outputs(out_items)
    cited = items.where("kind <> 'reference'").select(*CHAPTER, F.explode(cited_ranges(prose(F.col("text")))).alias("r")).select(*CHAPTER, "r.lo", "r.hi").distinct()
    cited = explode_range(cited, "lo", "hi", "no").distinct()
    entries = items.where("kind = 'reference'").select(*CHAPTER, F.explode(F.regexp_extract_all("text", F.lit(r'<a id="ref-([0-9]+)">'), F.lit(1))).alias("no")).select(*CHAPTER, F.col("no").cast("int").alias("no")).distinct()
    n = entries.groupBy(*CHAPTER).agg(F.count("*").alias("entries"))
    missing = cited.join(entries, [*CHAPTER, "no"], "left_anti").groupBy(*CHAPTER).agg(F.count("*").alias("n")).join(n, CHAPTER, "left")
    missing = missing.select(*CHAPTER, F.when(F.col("entries").isNull(), "REFERENCES_MISSING").otherwise("CITATION_NO_REFERENCE").alias("code"), "n")
    unused = entries.join(cited, [*CHAPTER, "no"], "left_anti").groupBy(*CHAPTER).agg(F.count("*").alias("n")).join(n, CHAPTER).where("n > 0.5 * entries")
    return missing.union(unused.select(*CHAPTER, F.lit("REFERENCE_NOT_CITED").alias("code"), "n"))


def current_chapters(chapters: DataFrame) -> DataFrame:
    """The row of each chapter that was added last."""
    fields = ["title", "start_page", "end_page", "confidence", "source"]
    last = chapters.where("number is not null").groupBy("book_id", F.col("number").alias("chapter")).agg(F.max_by(F.struct(*fields), "added_at").alias("c"))
    return last.select("book_id", "chapter", *(f"c.{f}" for f in fields))


def completeness(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, chapter, page, code, n_chars): pages of a chapter without any block, and pages with hardly any text."""
    pages = current_chapters(chapters).where("end_page >= start_page").select(*CHAPTER, F.explode(F.sequence("start_page", "end_page")).alias("page"))
    chars = sources(blocks).groupBy(*CHAPTER, "page").agg(F.sum(F.length("text")).alias("n_chars"))
    missing = pages.join(chars, [*CHAPTER, "page"], "left_anti").select(*CHAPTER, "page", F.lit("PAGE_SKIPPED").alias("code"), F.lit(0).cast("long").alias("n_chars"))
    return missing.union(chars.where("n_chars < 40").select(*CHAPTER, "page", F.lit("PAGE_SHORT"), "n_chars"))


def headings(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter, page, block_seq, level, text) of the headings."""
    rows = blocks.where("block_type = 'heading' and level is not null").select("book_id", chapter_of(F.col("block_id")).alias("chapter"), "page", "block_seq", "level", F.regexp_replace("raw_text", "\n", " ").alias("text"))
    return rows.distinct()


def in_order():
    return Window.partitionBy(*CHAPTER).orderBy("page", "block_seq")


def heading_skips(heads: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    return heads.withColumn("before", F.lag("level").over(in_order())).where("level > before + 1")


def heading_repair(heads: DataFrame) -> DataFrame:
    """Levels that go down one step at a time: each is the least of its own level and one more than the repaired level before. As a running
    minimum: the i-th is i + min(1, level_j - j for j up to i)."""
    i = F.row_number().over(in_order())
    rows = heads.withColumn("i", i)
    low = F.min(F.col("level") - F.col("i")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("repaired", (F.col("i") + F.least(low, F.lit(1))).cast("int"))
    return rows.select(*CHAPTER, "page", "block_seq", "level", "repaired", F.when(F.col("repaired") < F.col("level"), 0.7).otherwise(0.92).alias("confidence"))


def issues(blocks: DataFrame, out_items: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter, severity, code, page, message): everything the checks report."""
    null = F.lit(None).cast("int")
    recall = word_recall(blocks, out_items).where("severity <> 'NONE'")
    numbers = numeric_diff(blocks, out_items)
    parts = [
        numbers.select(*CHAPTER, "severity", "code", null.alias("page"), F.concat_ws(" ", F.lit("number"), "token").alias("message")),
        changed_numbers(numbers).select(*CHAPTER, "severity", "code", null, "message"),
        recall.select(*CHAPTER, "severity", F.lit("TEXT_LOSS"), null, F.concat_ws(" ", "lost", F.lit("words lost"))),
        citation_check(out_items).select(*CHAPTER, F.when(F.col("code") == "REFERENCE_NOT_CITED", "LOW").otherwise("MEDIUM"), "code", null, F.concat_ws(" ", "n", F.lit("numbers"))),
        completeness(chapters, blocks).select(*CHAPTER, F.when(F.col("code") == "PAGE_SKIPPED", "CRITICAL").otherwise("LOW"), "code", "page", F.concat_ws(" ", "n_chars", F.lit("characters"))),
        heading_skips(headings(blocks)).select(*CHAPTER, F.lit("MEDIUM"), F.lit("HEADING_SKIP"), "page", F.concat(F.lit("H"), "before", F.lit(" to H"), "level")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows


def severity_counts(all_issues: DataFrame, by: list[str]) -> DataFrame:
    return all_issues.groupBy(*by).agg(*(F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")))


def chapter_status(all_issues: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter, status): more than three critical issues fail, any needs a review, as do high ones; medium ones warn."""
    counts = current_chapters(chapters).select(*CHAPTER).join(severity_counts(all_issues, CHAPTER), CHAPTER, "left").na.fill(0)
    status = F.when(F.col("critical") > 3, "FAILED").when((F.col("critical") > 0) | (F.col("high") > 0), "REVIEW_REQUIRED").when(F.col("medium") > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")
    return counts.select(*CHAPTER, status.alias("status"))


def overview(all_issues: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, chapters, done, percent, pages_done, pages_total, needs_review): progress of a book; halves round to even."""
    pages = sources(blocks).groupBy(*CHAPTER).agg(F.count_distinct("page").alias("seen"))
    rows = current_chapters(chapters).join(chapter_status(all_issues, chapters), CHAPTER, "left").join(pages, CHAPTER, "left")
    done = F.count_if(F.col("status").isin("COMPLETED", "COMPLETED_WITH_WARNINGS", "REVIEW_REQUIRED"))
    return rows.groupBy("book_id").agg(
        F.count("*").alias("chapters"), done.alias("done"), F.bround(100 * done / F.count("*")).cast("int").alias("percent"),
        F.sum(F.coalesce("seen", F.lit(0))).alias("pages_done"), F.sum(F.col("end_page") - F.col("start_page") + 1).alias("pages_total"), F.count_if(F.col("confidence") < 0.6).alias("needs_review"),
    )


# The sections of a report and the codes they hold, in their order; severities in their order; words for statuses.
REPORT_SECTIONS = {
    "Structure": ["HEADING_UNCERTAIN", "HEADING_SKIP", "HYPHEN_KEPT"],
    "Pages Processed": ["PAGE_SKIPPED", "PAGE_SHORT", "TEXT_LOSS"],
    "Tables": ["TABLE_COMPLEX", "TABLE_NUMERIC_MISMATCH", "TABLE_COUNT", "TABLE_SEPARATE_FILE"],
    "Figures": ["FIGURE_NO_CAPTION", "CAPTION_NO_FIGURE", "FIGURE_COUNT", "FIGURE_BROKEN_PATH", "FIGURE_FILE_MISSING", "FIGURE_DUPLICATE"],
    "OCR": ["OCR_USED", "OCR_NUMERIC_UNVERIFIED"],
    "Numeric QA": ["MISSING_NUMBER", "CHANGED_NUMBER", "UNEXPECTED_NUMBER"],
    "Citation QA": ["CITATION_NO_REFERENCE", "REFERENCES_MISSING", "REFERENCE_NOT_CITED"],
    "Uncertain Text": ["UNCERTAIN_TEXT", "UNREADABLE_PAGE"],
}
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
STATUS_LABELS = {"COMPLETED": "PASS", "COMPLETED_WITH_WARNINGS": "PASS WITH WARNINGS", "REVIEW_REQUIRED": "REVIEW REQUIRED", "FAILED": "FAILED"}


def _one_of(value: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def reports(all_issues: DataFrame, blocks: DataFrame, out_items: DataFrame, chapters: DataFrame, books: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter, report): a page on each chapter in sections, every issue in the section of its code, the severe ones first. ``unresolved``:
    (book_id, chapter, text, page) of cross-references without a target."""
    code = F.col("code")
    rank = _one_of(F.col("severity"), {s: i for i, s in enumerate(SEVERITIES)})
    line = F.concat(F.lit("- **"), "severity", F.lit("** "), "message", F.when(F.col("page").isNull(), "").otherwise(F.format_string(" _(page %d)_", "page")))
    rows = all_issues.withColumn("rank", rank).withColumn("section", _one_of(code, {c: n for n, codes in REPORT_SECTIONS.items() for c in codes})).withColumn("place", _one_of(code, {c: i for codes in REPORT_SECTIONS.values() for i, c in enumerate(codes)})).withColumn("line", line)

    def text(*order: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce("page", F.lit(0)).alias("page"), "line"))), lambda x: x["line"]), "\n")

    parts = rows.where("section is not null").groupBy(*CHAPTER, "section").agg(text("rank", "place", "message").alias("text"))
    parts = parts.union(rows.where("rank < 2").groupBy(*CHAPTER).agg(text("rank", "code", "message").alias("text")).select(*CHAPTER, F.lit("review"), "text"))
    if unresolved is not None:
        refs = unresolved.withColumn("line", F.format_string("- %s (page %d)", "text", "page")).groupBy(*CHAPTER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line"))), lambda x: x["line"]), "\n").alias("text"))
        parts = parts.union(refs.select(*CHAPTER, F.lit("unresolved"), "text"))
    maps = parts.groupBy(*CHAPTER).agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("m"))
    items = outputs(out_items)
    n = items.groupBy(*CHAPTER).agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "table").alias("tables"))
    refs = items.where("kind = 'reference'").select(*CHAPTER, F.explode(F.regexp_extract_all("text", F.lit(r'<a id="ref-([0-9]+)">'), F.lit(1))).alias("no")).groupBy(*CHAPTER).agg(F.count_distinct("no").alias("refs"))
    seen = sources(blocks).groupBy(*CHAPTER).agg(F.count_distinct("page").alias("seen"))
    ocr = blocks.where("ocr").select("book_id", chapter_of(F.col("block_id")).alias("chapter"), "page").groupBy(*CHAPTER).agg(F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ", ").alias("ocr_pages"))
    book = books.groupBy("book_id").agg(F.max("title").alias("book_title"), F.max("edition").alias("edition"), F.max("source_sha256").alias("sha"))
    all_rows = current_chapters(chapters).join(chapter_status(all_issues, chapters), CHAPTER).join(severity_counts(all_issues, CHAPTER), CHAPTER, "left").join(maps, CHAPTER, "left")
    for side in (n, refs, seen, ocr):
        all_rows = all_rows.join(side, CHAPTER, "left")
    all_rows = all_rows.join(book, "book_id", "left").na.fill(0, ["critical", "high", "medium", "low", "headings", "tables", "refs", "seen"])

    def part(name: str, none: str = "None.") -> Column:
        return F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(none))

    def line_of(form: str, *cols: str | Column) -> Column:
        return F.format_string(form, *cols)

    lines = [
        line_of("# Conversion Report — Chapter %d: %s", "chapter", F.coalesce("title", F.lit(""))), "", "## Status", line_of("**%s**  (`%s`)", _one_of(F.col("status"), STATUS_LABELS), "status"), "", line_of("Issues: CRITICAL %d · HIGH %d · MEDIUM %d · LOW %d", "critical", "high", "medium", "low"), "",
        "## Source", line_of("- Book: %s (edition %s)", F.coalesce("book_title", F.lit("")), F.coalesce(F.nullif("edition", F.lit("")), F.lit("n/a"))), line_of("- SHA-256: `%s`", F.coalesce("sha", F.lit(""))), line_of("- Pages: %d–%d", "start_page", "end_page"), line_of("- Chapter detection: %s (confidence %.2f)", F.coalesce("source", F.lit("")), "confidence"), "",
        "## Structure", line_of("- Headings: %d", "headings"), part("Structure"), "", "## Pages Processed", line_of("- %d of %d pages", "seen", F.col("end_page") - F.col("start_page") + 1), part("Pages Processed"), "",
        "## Tables", line_of("- Tables extracted: %d", "tables"), part("Tables"), "", "## Figures", part("Figures"), "", "## OCR", line_of("- Pages with recognised text: %s", F.coalesce("ocr_pages", F.lit("none"))), part("OCR"), "",
        "## Numeric QA", part("Numeric QA", "No numeric differences between source extraction and Markdown."), "", "## Citation QA", line_of("- Reference entries preserved: %d", "refs"), part("Citation QA"), "", "## Uncertain Text", part("Uncertain Text"), "",
        "## Possible Source Typos", "None detected (the converter never edits source text).", "", "## Unresolved Cross References", part("unresolved"), "", "## Human Review Recommended", part("review", "No."),
    ]
    return all_rows.select(*CHAPTER, F.concat(F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines)), F.lit("\n")).alias("report"))
