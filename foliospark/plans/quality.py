"""Queries that check converted text against its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import number_tokens, word_tokens
from foliospark.operators import quality as Q
from foliospark.plans.registry import query
from foliospark.session import table

SRC = "src as (select distinct book_id, regexp_extract(block_id, '^ch([0-9]+)-', 1)::int as chapter, block_id, page, raw_text as text from blocks where raw_text is not null)"
OUT = "outp as (select distinct book_id, chapter, ord, kind, page, md as text from out_items where md is not null)"
_NUM = r"""list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '−–—', '---'), '(?s)<!--.*?-->', ' ', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\]\([^)]*\)', ']', 'g'), '\[\^[0-9]+\]', ' ', 'g'), '[0-9]+(?:[.,][0-9]+)*'), lambda t: replace(t, ',', ''))"""
_WORDS = r"""list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g'), '[A-Za-z]{3,}'), lambda t: lower(t))"""
_DOSE = r"(?i)[0-9]+(?:\.[0-9]+)? ?(?:mg|mcg|µg|μg|g|kg|mL|ml|L|IU|U|units?|mmol|mEq|mmHg|%|°C|bpm)\b"


def _bags(tokens: str, p: str) -> str:
    return f"""{p}a as (select book_id, chapter, token, count(*) as n_src from (select book_id, chapter, unnest({tokens}) as token from src) group by all),
{p}b as (select book_id, chapter, token, count(*) as n_out from (select book_id, chapter, unnest({tokens}) as token from outp) group by all),
{p}diff as (select book_id, chapter, token, coalesce(n_src, 0) as n_src, coalesce(n_out, 0) as n_out from {p}a full join {p}b using (book_id, chapter, token))"""


NUMERIC = f"""{_bags(_NUM, 'n')}, dosed as (select book_id, chapter, list(distinct dose) as doses from (select book_id, chapter, unnest(regexp_extract_all(text, '{_DOSE}')) as dose from src) group by all),
numeric_issues as (select book_id, chapter, token, abs(n_src - n_out) as n, case when n_src > n_out then 'MISSING_NUMBER' else 'UNEXPECTED_NUMBER' end as code,
  case when n_src < n_out or coalesce(len(list_filter(doses, lambda x: regexp_matches(x, '(?:^|[^0-9.])' || replace(token, '.', '\\.')))) > 0, false) then 'HIGH' else 'MEDIUM' end as severity
  from ndiff left join dosed using (book_id, chapter) where n_src <> n_out)"""
RECALL = f"""{_bags(_WORDS, 'w')}, sums as (select book_id, chapter, sum(greatest(n_src - n_out, 0))::bigint as lost, sum(n_src)::bigint as total from wdiff group by all),
recall as (select book_id, chapter, lost, total, round(lost / greatest(total, 1), 6) as ratio, case when lost / greatest(total, 1) > 0.05 then 'CRITICAL' when lost / greatest(total, 1) > 0.01 then 'HIGH' else 'NONE' end as severity from sums)"""
_CITES = r"""cparts as (select book_id, chapter, unnest(string_split_regex(regexp_replace(g, '[ \x{A0}]', '', 'g'), '[,;]')) as p from (select book_id, chapter, unnest(regexp_extract_all(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?(?:```|$)', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), '(?s)\$\$.*?\$\$', ' ', 'g'), '\$[^$\n]+\$', ' ', 'g'), '\]\([^()\n]*\)', ']', 'g'),
  '\[([0-9]{1,9}(?:[ \x{A0}]*[,;\-‐‑–—−][ \x{A0}]*[0-9]{1,9})*)\]', 1)) as g from outp where kind <> 'reference')),
cited as (select distinct book_id, chapter, unnest(case when regexp_matches(p, '^[0-9]+$') then [p::int] else range(regexp_extract(p, '^([0-9]+)[-‐‑–—−]([0-9]+)$', 1)::int, regexp_extract(p, '^([0-9]+)[-‐‑–—−]([0-9]+)$', 2)::int + 1) end)::int as no from cparts),
entries as (select distinct book_id, chapter, unnest(regexp_extract_all(text, '<a id="ref-([0-9]+)">', 1))::int as no from outp where kind = 'reference'),
en as (select book_id, chapter, count(*) as entries from entries group by all),
citations as (select book_id, chapter, case when entries is null then 'REFERENCES_MISSING' else 'CITATION_NO_REFERENCE' end as code, n from
  (select book_id, chapter, count(*) as n from (select * from cited anti join entries using (book_id, chapter, no)) group by all) left join en using (book_id, chapter)
  union all select book_id, chapter, 'REFERENCE_NOT_CITED', n from (select book_id, chapter, count(*) as n from (select * from entries anti join cited using (book_id, chapter, no)) group by all) join en using (book_id, chapter) where n > 0.5 * entries)"""
CURRENT = "cur as (select book_id, number as chapter, c.* from (select book_id, number, arg_max({title: title, start_page: start_page, end_page: end_page, confidence: confidence, source: source}, added_at) as c from chapters where number is not null group by all))"
_COMPLETE = """chars as (select book_id, chapter, page, sum(length(text))::bigint as n_chars from src group by all),
complete as (select book_id, chapter, page::int as page, 'PAGE_SKIPPED' as code, 0 as n_chars from (select book_id, chapter, unnest(range(start_page, end_page + 1)) as page from cur where end_page >= start_page) anti join chars using (book_id, chapter, page)
  union all select book_id, chapter, page, 'PAGE_SHORT', n_chars from chars where n_chars < 40)"""
HEADS = "heads as (select distinct book_id, regexp_extract(block_id, '^ch([0-9]+)-', 1)::int as chapter, page, block_seq, level, replace(raw_text, chr(10), ' ') as text from blocks where block_type = 'heading' and level is not null)"
_SKIPS = "skips as (select * from (select *, lag(level) over (partition by book_id, chapter order by page, block_seq) as before from heads) where level > before + 1)"
ISSUES = f"""with {SRC}, {OUT}, {NUMERIC}, {RECALL}, {_CITES}, {CURRENT}, {_COMPLETE}, {HEADS}, {_SKIPS},
issues as (select book_id, chapter, severity, code, null::int as page, 'number ' || token as message from numeric_issues
  union all select book_id, chapter, 'HIGH', 'CHANGED_NUMBER', null, 'missing ' || array_to_string(list_sort(list(distinct token) filter (where code = 'MISSING_NUMBER'))[1:5], ', ') || ' / unexpected ' || array_to_string(list_sort(list(distinct token) filter (where code = 'UNEXPECTED_NUMBER'))[1:5], ', ')
    from numeric_issues group by book_id, chapter having count(*) filter (where code = 'MISSING_NUMBER') > 0 and count(*) filter (where code = 'UNEXPECTED_NUMBER') > 0
  union all select book_id, chapter, severity, 'TEXT_LOSS', null, lost || ' words lost' from recall where severity <> 'NONE'
  union all select book_id, chapter, case when code = 'REFERENCE_NOT_CITED' then 'LOW' else 'MEDIUM' end, code, null, n || ' numbers' from citations
  union all select book_id, chapter, case when code = 'PAGE_SKIPPED' then 'CRITICAL' else 'LOW' end, code, page, n_chars || ' characters' from complete
  union all select book_id, chapter, 'MEDIUM', 'HEADING_SKIP', page, 'H' || before || ' to H' || level from skips),
counts as (select book_id, chapter, count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where severity = 'HIGH') as high, count(*) filter (where severity = 'MEDIUM') as medium, count(*) filter (where severity = 'LOW') as low from issues group by all),
status as (select book_id, chapter, case when critical > 3 then 'FAILED' when critical > 0 or high > 0 then 'REVIEW_REQUIRED' when medium > 0 then 'COMPLETED_WITH_WARNINGS' else 'COMPLETED' end as status from cur left join counts using (book_id, chapter))
"""


def _t(spark: SparkSession, d: str, *names: str):
    return [table(spark, d, n) for n in names]


def all_issues(spark: SparkSession, d: str) -> DataFrame:
    return Q.issues(*_t(spark, d, "blocks", "out_items", "chapters"))


@query(f"with {SRC}, {OUT}, {NUMERIC} select * from numeric_issues")
def numeric_fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the source that the output lost or changed."""
    return Q.numeric_diff(*_t(spark, d, "blocks", "out_items"))


@query(
    f"""with {SRC}, {OUT}, {NUMERIC} select book_id, chapter, 'HIGH' as severity, 'CHANGED_NUMBER' as code,
      'missing ' || array_to_string(list_sort(list(distinct token) filter (where code = 'MISSING_NUMBER'))[1:5], ', ') || ' / unexpected ' || array_to_string(list_sort(list(distinct token) filter (where code = 'UNEXPECTED_NUMBER'))[1:5], ', ') as message
    from numeric_issues group by book_id, chapter having count(*) filter (where code = 'MISSING_NUMBER') > 0 and count(*) filter (where code = 'UNEXPECTED_NUMBER') > 0"""
)
def changed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Chapters in which numbers seem to have been changed."""
    return Q.changed_numbers(Q.numeric_diff(*_t(spark, d, "blocks", "out_items")))


@query(f"with {SRC}, {OUT}, {RECALL} select * from recall")
def word_recall(spark: SparkSession, d: str) -> DataFrame:
    """Words of the source that the output lost."""
    return Q.word_recall(*_t(spark, d, "blocks", "out_items"))


@query(f"with {SRC}, {OUT}, {_bags(_WORDS, 'w')} select token, sum(n_src - n_out)::bigint as lost from wdiff where n_src > n_out group by token")
def lost_words(spark: SparkSession, d: str) -> DataFrame:
    """The words lost, as a difference of bags that keeps multiplicities."""
    blocks, items = _t(spark, d, "blocks", "out_items")
    a = Q.sources(blocks).select("book_id", "chapter", F.explode(word_tokens(F.col("text"))).alias("token"))
    b = Q.outputs(items).select("book_id", "chapter", F.explode(word_tokens(F.col("text"))).alias("token"))
    return a.exceptAll(b).groupBy("token").agg(F.count("*").alias("lost"))


@query(
    f"""with {SRC}, {OUT}, {_bags(_WORDS, 'w')}, gaps as (select book_id, chapter, token, n_src - n_out as gap from wdiff where n_src <> n_out),
    cuts as (select book_id, chapter, token as word, unnest(range(3, length(token) - 2)) as cut from gaps where gap < 0 and length(token) >= 6),
    cand as (select c.*, l.token as l, l.gap as gl, r.token as r, r.gap as gr, row_number() over (partition by c.book_id, c.chapter, c.word order by cut) as k from cuts c
      join gaps l on l.book_id = c.book_id and l.chapter = c.chapter and l.token = c.word[1:cut] and l.gap > 0 join gaps r on r.book_id = c.book_id and r.chapter = c.chapter and r.token = c.word[cut + 1:] and r.gap > 0),
    parts as (select book_id, chapter, word, l as part, gl as gap, 1 as side from cand where k = 1 union all select book_id, chapter, word, r, gr, 2 from cand where k = 1),
    ranked as (select *, row_number() over (partition by book_id, chapter, part order by word, side) as n from parts),
    fits as (select book_id, chapter, word, min((n <= gap)::int) as fits from ranked group by all), freed as (select book_id, chapter, 2 * sum(fits) as freed from fits group by all)
    select book_id, chapter, coalesce(freed, 0)::bigint as freed, (missing - coalesce(freed, 0))::bigint as lost from (select book_id, chapter, sum(greatest(gap, 0)) as missing from gaps group by all) left join freed using (book_id, chapter)"""
)
def split_word_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Missing words after words divided in the source are matched with whole ones."""
    blocks, items = _t(spark, d, "blocks", "out_items")
    diff = Q.bag_difference(Q.bag(Q.sources(blocks), word_tokens(F.col("text")), "n_src"), Q.bag(Q.outputs(items), word_tokens(F.col("text")), "n_out"))
    return Q.reconcile_split_words(diff)


@query(f"with {OUT}, {_CITES} select * from citations")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Citations without an entry, entries without a citation."""
    return Q.citation_check(table(spark, d, "out_items"))


_CASE_SRC = SRC.replace("from blocks where raw_text is not null)", "from blocks where raw_text is not null union all select 'cases', 1, 'x', p, t from (values (1, 'short'), (3, repeat('long ', 20))) v(p, t))")
_CASE_CUR = CURRENT.replace("from chapters where number is not null", "from (select book_id, number, title, start_page, end_page, confidence, source, added_at from chapters union all select 'cases', 1, 'x', 1, 4, 1.0, 'manual', timestamp '2020-01-01') where number is not null")


@query(f"with {_CASE_SRC}, {_CASE_CUR}, {_COMPLETE} select * from complete")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a chapter that are missing or hardly hold text (A13, X2); with one literal chapter, since no page of the tables is missing."""
    chapters, blocks = _t(spark, d, "chapters", "blocks")
    c = spark.createDataFrame([("cases", 1, "x", 1, 4, 1.0, "manual")], "book_id STRING, number INT, title STRING, start_page INT, end_page INT, confidence DOUBLE, source STRING")
    c = c.withColumn("added_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    b = spark.createDataFrame([("cases", "ch001-p0001-b001", 1, "short"), ("cases", "ch001-p0003-b001", 3, "long " * 20)], "book_id STRING, block_id STRING, page INT, raw_text STRING")
    return Q.completeness(chapters.unionByName(c, allowMissingColumns=True), blocks.unionByName(b, allowMissingColumns=True))


@query(f"with {HEADS}, {_SKIPS} select * from skips")
def heading_skips(spark: SparkSession, d: str) -> DataFrame:
    """Headings that skip a level."""
    return Q.heading_skips(Q.headings(table(spark, d, "blocks")))


@query(
    f"""with recursive {HEADS}, seq as (select *, row_number() over (partition by book_id, chapter order by page, block_seq) as i from heads),
    fold as (select book_id, chapter, page, block_seq, level, i, least(level, 2) as repaired from seq where i = 1
      union all select s.book_id, s.chapter, s.page, s.block_seq, s.level, s.i, least(s.level, f.repaired + 1) from fold f join seq s on s.book_id = f.book_id and s.chapter = f.chapter and s.i = f.i + 1)
    select book_id, chapter, page, block_seq, level, repaired, case when repaired < level then 0.7::double else 0.92::double end as confidence from fold"""
)
def heading_repair(spark: SparkSession, d: str) -> DataFrame:
    """Heading levels that go down one step at a time."""
    return Q.heading_repair(Q.headings(table(spark, d, "blocks")))


@query(ISSUES + "select severity, code, count(*) as n from issues group by all")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Issues by severity and code."""
    return all_issues(spark, d).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query(ISSUES + "select * from status")
def chapter_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each chapter by its issues."""
    return Q.chapter_status(all_issues(spark, d), table(spark, d, "chapters"))


@query(
    ISSUES
    + """select book_id, count(*) as chapters, count(*) filter (where status in ('COMPLETED', 'COMPLETED_WITH_WARNINGS', 'REVIEW_REQUIRED')) as done,
    round_even(100 * count(*) filter (where status in ('COMPLETED', 'COMPLETED_WITH_WARNINGS', 'REVIEW_REQUIRED')) / count(*), 0)::int as percent,
    sum(coalesce(seen, 0))::bigint as pages_done, sum(end_page - start_page + 1)::bigint as pages_total, count(*) filter (where confidence < 0.6) as needs_review
    from cur left join status using (book_id, chapter) left join (select book_id, chapter, count(distinct page) as seen from src group by all) using (book_id, chapter) group by book_id"""
)
def overview(spark: SparkSession, d: str) -> DataFrame:
    """Progress of each book."""
    chapters, blocks = _t(spark, d, "chapters", "blocks")
    return Q.overview(all_issues(spark, d), chapters, blocks)


_SECTIONS = {
    "Structure": ("HEADING_UNCERTAIN", "HEADING_SKIP", "HYPHEN_KEPT"), "Pages Processed": ("PAGE_SKIPPED", "PAGE_SHORT", "TEXT_LOSS"), "Tables": ("TABLE_COMPLEX", "TABLE_NUMERIC_MISMATCH", "TABLE_COUNT", "TABLE_SEPARATE_FILE"),
    "Figures": ("FIGURE_NO_CAPTION", "CAPTION_NO_FIGURE", "FIGURE_COUNT", "FIGURE_BROKEN_PATH", "FIGURE_FILE_MISSING", "FIGURE_DUPLICATE"), "OCR": ("OCR_USED", "OCR_NUMERIC_UNVERIFIED"), "Numeric QA": ("MISSING_NUMBER", "CHANGED_NUMBER", "UNEXPECTED_NUMBER"),
    "Citation QA": ("CITATION_NO_REFERENCE", "REFERENCES_MISSING", "REFERENCE_NOT_CITED"), "Uncertain Text": ("UNCERTAIN_TEXT", "UNREADABLE_PAGE"),
}
_ROUTE = "case code " + " ".join(f"when '{c}' then '{name}'" for name, codes in _SECTIONS.items() for c in codes) + " end"
_PLACE = "case code " + " ".join(f"when '{c}' then {i}" for codes in _SECTIONS.values() for i, c in enumerate(codes)) + " end"
_LINE = "'- **' || severity || '** ' || message || case when page is null then '' else ' _(page ' || page || ')_' end"


def _section(name: str, none: str = "None.") -> str:
    return f"coalesce(m['{name}'], '{none}') || chr(10) || chr(10)"


@query(
    ISSUES
    + f""", ranked as (select *, case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end as rank, {_ROUTE} as section, {_PLACE} as place, {_LINE} as line from issues),
    secs as (select book_id, chapter, section, string_agg(line, chr(10) order by rank, place, message, page) as text from ranked where section is not null group by all union all
      select book_id, chapter, 'review', string_agg(line, chr(10) order by rank, code, message, page) from ranked where rank < 2 group by all),
    maps as (select book_id, chapter, map_from_entries(list({{k: section, v: text}})) as m from secs group by all),
    its as (select distinct book_id, chapter, ord, kind, md from out_items), n as (select book_id, chapter, count(*) filter (where kind = 'heading') as headings, count(*) filter (where kind = 'table') as tables from its group by all),
    rf as (select book_id, chapter, count(distinct no) as refs from (select book_id, chapter, unnest(regexp_extract_all(md, '<a id="ref-([0-9]+)">', 1)) as no from its where kind = 'reference') group by all),
    pg as (select book_id, chapter, count(distinct page) as seen from src group by all), oc as (select book_id, chapter, array_to_string(list_sort(list(distinct page)), ', ') as pages from (select book_id, regexp_extract(block_id, '^ch([0-9]+)-', 1)::int as chapter, page from blocks where ocr) group by all),
    bk as (select book_id, max(title) as book_title, max(edition) as edition, max(source_sha256) as sha from books group by 1)
    select book_id, chapter, '# Conversion Report — Chapter ' || chapter || ': ' || coalesce(c.title, '') || chr(10) || chr(10) || '## Status' || chr(10) || '**' || case status when 'COMPLETED' then 'PASS' when 'COMPLETED_WITH_WARNINGS' then 'PASS WITH WARNINGS' when 'REVIEW_REQUIRED' then 'REVIEW REQUIRED' else status end || '**  (`' || status || '`)' || chr(10) || chr(10)
      || 'Issues: CRITICAL ' || coalesce(critical, 0) || ' · HIGH ' || coalesce(high, 0) || ' · MEDIUM ' || coalesce(medium, 0) || ' · LOW ' || coalesce(low, 0) || chr(10) || chr(10)
      || '## Source' || chr(10) || '- Book: ' || coalesce(book_title, '') || ' (edition ' || coalesce(nullif(edition, ''), 'n/a') || ')' || chr(10) || '- SHA-256: `' || coalesce(sha, '') || '`' || chr(10) || '- Pages: ' || start_page || '–' || end_page || chr(10) || '- Chapter detection: ' || coalesce(source, '') || ' (confidence ' || printf('%.2f', confidence) || ')' || chr(10) || chr(10)
      || '## Structure' || chr(10) || '- Headings: ' || coalesce(headings, 0) || chr(10) || {_section('Structure')} || '## Pages Processed' || chr(10) || '- ' || coalesce(seen, 0) || ' of ' || (end_page - start_page + 1) || ' pages' || chr(10) || {_section('Pages Processed')}
      || '## Tables' || chr(10) || '- Tables extracted: ' || coalesce(tables, 0) || chr(10) || {_section('Tables')} || '## Figures' || chr(10) || {_section('Figures')} || '## OCR' || chr(10) || '- Pages with recognised text: ' || coalesce(oc.pages, 'none') || chr(10) || {_section('OCR')}
      || '## Numeric QA' || chr(10) || {_section('Numeric QA', 'No numeric differences between source extraction and Markdown.')} || '## Citation QA' || chr(10) || '- Reference entries preserved: ' || coalesce(refs, 0) || chr(10) || {_section('Citation QA')}
      || '## Uncertain Text' || chr(10) || {_section('Uncertain Text')} || '## Possible Source Typos' || chr(10) || 'None detected (the converter never edits source text).' || chr(10) || chr(10)
      || '## Unresolved Cross References' || chr(10) || 'None.' || chr(10) || chr(10) || '## Human Review Recommended' || chr(10) || coalesce(m['review'], 'No.') || chr(10) as report
    from cur c join status using (book_id, chapter) left join counts using (book_id, chapter) left join maps using (book_id, chapter) left join n using (book_id, chapter) left join rf using (book_id, chapter) left join pg using (book_id, chapter) left join oc using (book_id, chapter) left join bk using (book_id)"""
)
def report(spark: SparkSession, d: str) -> DataFrame:
    """Report of each chapter: its issues by section, in the order of their severity (K6, T2). No cross-reference is given to it here."""
    blocks, items, chapters, books = _t(spark, d, "blocks", "out_items", "chapters", "books")
    return Q.reports(Q.issues(blocks, items, chapters), blocks, items, chapters, books)
