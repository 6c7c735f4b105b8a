"""Queries on assembled chapters, books and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import tables as T
from foliospark.operators import assembly as A
from foliospark.operators import layout as Y
from foliospark.operators import quality as Q
from foliospark.operators import structure as S
from foliospark.operators.lines import running_margin_lines, unique_lines
from foliospark.plans.layout import BODY, LINES
from foliospark.plans.quality import CURRENT, HEADS, ISSUES
from foliospark.plans.registry import joined, query
from foliospark.plans.structure import ITEMS, PATHS
from foliospark.plans.text import _MARGIN
from foliospark.session import table

_WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _yaml(x: str) -> str:
    return f"""'"' || replace(replace(coalesce({x}, ''), '\\', '\\\\'), '"', '\\"') || '"'"""


_ANCHOR = "replace(" + _strip("regexp_replace(lower(t), '[^\\p{L}\\p{N}_\\- ]', '', 'g')") + ", ' ', '-')"
_NL = "chr(10)"


@query(
    f"""with {ITEMS}, {CURRENT}, shown as (select *, (page is distinct from lag(page) over w or lag(ord) over w is null) as fresh from items where md is not null and md <> '' and kind not in ('chapter_title', 'footnote') window w as (partition by book_id, chapter order by ord)),
    body as (select book_id, chapter, string_agg(case when fresh then '<!-- source_page: ' || page || ' -->' || {_NL} || {_NL} else '' end || md, {_NL} || {_NL} order by ord) as body from shown group by all),
    h2 as (select *, row_number() over (partition by book_id, chapter order by ord) as k from (select book_id, chapter, ord, regexp_extract(md, '^#{{1,6}} ([^\\n]*)', 1) as t from items where kind = 'heading' and level = 2)),
    toc as (select book_id, chapter, '## Contents' || {_NL} || {_NL} || string_agg('- [' || t || '](#' || {_ANCHOR} || ')', {_NL} order by k) || {_NL} || {_NL} as toc from h2 where k <= 30 group by all having count(*) >= 3),
    bk as (select book_id, max(title) as book_title, max(edition) as edition, max(slug) as slug, max(source_sha256) as source_sha256 from books group by 1),
    m as (select book_id, chapter, '---' || {_NL} || 'book_title: ' || {_yaml('book_title')} || {_NL} || 'edition: ' || {_yaml('edition')} || {_NL} || 'chapter_number: ' || chapter || {_NL} || 'chapter_title: ' || {_yaml('title')} || {_NL} || 'source_pages: "' || start_page || '-' || end_page || '"' || {_NL}
      || 'language: "en"' || {_NL} || 'content_type: "textbook_chapter"' || {_NL} || 'source_sha256: ' || {_yaml('source_sha256')} || {_NL} || '---' || {_NL} || {_NL} || '# ' || coalesce(title, '') || {_NL} || '<!-- section_id: ' || slug || '-ch' || chapter || ' -->' || {_NL} || {_NL} || coalesce(toc, '') || body || {_NL} as markdown
      from body join cur using (book_id, chapter) join bk using (book_id) left join toc using (book_id, chapter))
    select book_id, chapter, length(markdown) as n_chars, sha256(markdown) as sha256 from m"""
)
def markdown_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as Markdown files (K3, W19, P30); compared by their hash."""
    md = A.chapter_markdown(S.ordered_items(table(spark, d, "out_items")), table(spark, d, "chapters"), table(spark, d, "books"))
    return md.select("book_id", "chapter", F.length("markdown").alias("n_chars"), "sha256")


_FP = f"left(sha256(lower({_strip(f'''regexp_replace(coalesce(cleaned, md), '{_WS}+', ' ', 'g')''')})), 16)"


@query(
    f"""with {PATHS} select book_id, chapter, ord, block_id, kind as type, section_id, page as source_page, round_even(x0, 1) as x0, round_even(y0, 1) as y0, round_even(x1, 1) as x1, round_even(y1, 1) as y1, array_to_string(path, '|') as path, {_FP} as fingerprint,
    round_even(confidence, 2) as confidence, case when coalesce(raw, '') = '' then '' else left(sha256(raw), 12) end as raw_hash from items join paths using (book_id, chapter, ord) where md is not null and md <> ''"""
)
def source_map(spark: SparkSession, d: str) -> DataFrame:
    """Where each item comes from (K4)."""
    return joined(A.source_map(S.ordered_items(table(spark, d, "out_items"))), "path")


#: A chapter counts as converted if it has items; the hash of its items' Markdown stands for that of its file.
_FILES = """bk as (select book_id, max(title) as book_title, max(edition) as edition, max(slug) as slug, max(source_sha256) as source_sha256, max(page_count) as page_count from books group by 1),
fl as (select book_id, chapter, md5(string_agg(md, chr(10) order by ord)) as sha256 from (select distinct book_id, chapter, ord, md from out_items where md is not null) group by all),
bc as (select c.*, coalesce(status, 'NOT_STARTED') as st, sha256, case when sha256 is not null then 'chapters/ch_' || lpad(chapter::varchar, 3, '0') || '.md' end as file from cur c left join status using (book_id, chapter) left join fl using (book_id, chapter))"""
_WORD = "case st when 'NOT_STARTED' then 'Not started' when 'PROCESSING' then 'Processing' when 'PARTIAL' then 'Partial' when 'COMPLETED' then 'Completed' when 'COMPLETED_WITH_WARNINGS' then 'Completed with warnings' when 'REVIEW_REQUIRED' then 'Review required' when 'FAILED' then 'Failed' end"


def _book_parts(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    chapters, items = table(spark, d, "chapters"), table(spark, d, "out_items")
    issues = Q.issues(table(spark, d, "blocks"), items, chapters)
    texts = items.where("md is not null").select("book_id", "chapter", "ord", "md").distinct().groupBy("book_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("ord", "md"))).alias("l"))
    files = texts.select("book_id", "chapter", F.md5(F.array_join(F.transform("l", lambda x: x["md"]), "\n")).alias("sha256"))
    return table(spark, d, "books"), chapters, Q.chapter_status(issues, chapters), files


@query(
    ISSUES
    + f""", {_FILES}, r as (select book_id, count(*) as chapters, string_agg('| ' || chapter || ' | ' || case when file is null then coalesce(title, '') else '[' || coalesce(title, '') || '](' || file || ')' end || ' |  | ' || start_page || '–' || end_page || ' | '
      || case when file is null then '—' else '[' || string_split(file, '/')[-1] || '](' || file || ')' end || ' | ' || {_WORD} || ' |', {_NL} order by chapter) as l from bc group by 1)
    select book_id, chapters, '# ' || coalesce(book_title, '') || case when coalesce(edition, '') <> '' then ' — Edition ' || edition else '' end || {_NL} || {_NL} || '| Chapter | Title | Specialty | Source Pages | Markdown File | Conversion Status |' || {_NL} || '|---|---|---|---|---|---|' || {_NL} || l || {_NL} as page from r join bk using (book_id)"""
)
def book_index(spark: SparkSession, d: str) -> DataFrame:
    """Index page of each book (K7)."""
    return A.book_index(*_book_parts(spark, d))


@query(
    ISSUES
    + f""", {_FILES}, r as (select book_id, string_agg('  - number: ' || chapter || {_NL} || '    title: ' || {_yaml('title')} || {_NL} || '    pages: "' || start_page || '-' || end_page || '"' || {_NL} || '    status: ' || st, {_NL} order by chapter) as l from bc group by 1)
    select book_id, 'title: ' || {_yaml('book_title')} || {_NL} || 'edition: ' || {_yaml('edition')} || {_NL} || 'source_sha256: ' || {_yaml('source_sha256')} || {_NL} || 'pages: ' || coalesce(page_count::varchar, 'null') || {_NL} || 'slug: ' || {_yaml('slug')} || {_NL} || 'chapters:' || {_NL} || l || {_NL} as yaml from r join bk using (book_id)"""
)
def book_yaml(spark: SparkSession, d: str) -> DataFrame:
    """The metadata file of each book (K7)."""
    return A.book_yaml(*_book_parts(spark, d))


@query(
    ISSUES
    + f""", {_FILES}, r as (select book_id, list({{'chapter': chapter, 'title': title, 'start_page': start_page, 'end_page': end_page, 'status': st}} order by chapter) as chapters, list({{'chapter': chapter, 'file': file, 'sha256': sha256, 'status': st}} order by chapter) filter (where file is not null) as chapter_files from bc group by 1)
    select book_id, len(coalesce(chapter_files, [])) as n_files, to_json({{'title': book_title, 'edition': edition, 'source_sha256': source_sha256, 'pages': page_count, 'chapters': chapters, 'chapter_files': coalesce(chapter_files, [])}})::varchar as manifest from r join bk using (book_id)"""
)
def book_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of each book."""
    return A.manifest(*_book_parts(spark, d))


@query("with bk as (select book_id, max(title) as t, max(edition) as e, max(source_sha256) as sha from books group by 1) select book_id, '# ' || coalesce(t, '') || ' — Markdown Knowledge Base' as first_line, '- **Source book:** ' || coalesce(t, '') || case when coalesce(e, '') <> '' then ' (edition ' || e || ')' else '' end as source_line, '- **Source SHA-256:** `' || coalesce(sha, '') || '`' as sha_line from bk")
def book_readme(spark: SparkSession, d: str) -> DataFrame:
    """The read-me page of each book, of which the lines that differ are shown (K7)."""
    lines = F.split("page", "\n")
    return A.readme(table(spark, d, "books")).select("book_id", F.get(lines, F.lit(0)).alias("first_line"), F.get(lines, F.lit(2)).alias("source_line"), F.get(lines, F.lit(3)).alias("sha_line"))


@query(
    f"""with {LINES}, {BODY}, {HEADS}, n as (select book_id, count(distinct page) as n from l group by 1),
    k as (select book_id, {_MARGIN} as margin, count(distinct page) as pages from l where (y0 + y1) / 2 < 64.0 or (y0 + y1) / 2 > 736.0 group by 1, 2),
    m as (select book_id, list_sort(list(distinct margin)) as running_headers from k join n using (book_id) where margin <> '' and pages >= greatest(2, floor(0.4 * n)) group by 1),
    h as (select book_id, list_sort(list(distinct level)) as levels_seen from heads group by 1)
    select book_id, body as body_font_size, coalesce(array_to_string(running_headers, '|'), '') as running_headers, coalesce(array_to_string(list_transform(levels_seen, lambda x: x::varchar), '|'), '') as levels_seen from body left join m using (book_id) left join h using (book_id)"""
)
def book_memory(spark: SparkSession, d: str) -> DataFrame:
    """What later conversions of a book may use."""
    pages = table(spark, d, "page_lines")
    m = A.memory(running_margin_lines(unique_lines(pages)), Y.body_size(pages), Q.headings(table(spark, d, "blocks")))
    return joined(joined(m, "running_headers"), "levels_seen")


_SUP = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ⁻"
_SUB = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"


@query(
    f"""with u as (select distinct book_id, page, block_seq, line_no, spans from page_lines where spans is not null),
    e as (select book_id, page, block_seq, line_no, i, coalesce(s.text, '') as t, coalesce(s.sup, false) as sup, coalesce(s.sub, false) as sub, coalesce(s.bold, false)::int * 2 + coalesce(s.italic, false)::int as st from (select *, unnest(spans) as s, generate_subscripts(spans, 1) as i from u)),
    g as (select *, sum((sup or sub)::int) over w as seg, trim(t) = '' as blank from e window w as (partition by book_id, page, block_seq, line_no order by i)),
    f as (select *, case when sup or sub then -2 else coalesce(last_value(case when not blank and not sup and not sub then st end ignore nulls) over (partition by book_id, page, block_seq, line_no, seg, sup or sub order by i rows between unbounded preceding and current row), -1) end as style from g),
    k as (select *, case when sup or sub or style is distinct from lag(style) over w or lag(seg) over w is distinct from seg then 1 else 0 end as fresh from f window w as (partition by book_id, page, block_seq, line_no order by i)),
    n as (select *, sum(fresh) over (partition by book_id, page, block_seq, line_no order by i) as run from k),
    r as (select book_id, page, block_seq, line_no, run, min(style) as style, bool_or(sup) as sup, bool_or(sub) as sub, string_agg(t, '' order by i) as t from n group by all),
    m as (select *, trim(t) as core, case style when 3 then '***' when 2 then '**' when 1 then '*' else '' end as mark from r),
    o as (select *, case when core = '' then t
      when sup then case when not (regexp_matches(core, '^[0-9, –-]+$') and regexp_matches(core, '[0-9]') and not regexp_matches(core, '^[0-9]$')) and regexp_matches(core, '^[0-9+−=()ni-]+$') then translate(core, '0123456789+-=()ni−', '{_SUP}') else '<sup>' || core || '</sup>' end
      when sub then case when regexp_matches(core, '^[0-9+=()-]+$') then translate(core, '0123456789+-=()', '{_SUB}') else '<sub>' || core || '</sub>' end
      else left(t, instr(t, core) - 1) || mark || core || mark || substr(t, instr(t, core) + length(core)) end as x from m)
    select book_id, page, block_seq, line_no, coalesce(string_agg(x, '' order by run), '') as marked from u left join o using (book_id, page, block_seq, line_no) group by all"""
)
def inline_markup(spark: SparkSession, d: str) -> DataFrame:
    """Lines with inline marks (P25)."""
    lines = table(spark, d, "page_lines").where("spans is not null").select("book_id", "page", "block_seq", "line_no", "spans").distinct()
    return lines.select("book_id", "page", "block_seq", "line_no", A.inline_marks(F.col("spans")).alias("marked"))


_ROWS = r"""rws as (select distinct book_id, block_id, page, list_transform(list_filter(string_split(markdown, chr(10)), lambda x: regexp_matches(x, '^\|') and not regexp_matches(x, '^\|[-| :]+\|?$')),
  lambda x: list_transform(string_split_regex(regexp_replace(x, '^\|[ ]*|[ ]*\|[ ]*$', '', 'g'), '[ ]*\|[ ]*'), lambda c: trim(regexp_replace(replace(c, chr(160), ' '), '[\t-\r ]+', ' ', 'g')))) as rows from blocks where block_type = 'table' and markdown is not null),
tabs as (select *, len(rows) as n_rows, list_max(list_transform(rows, lambda r: len(r))) as n_cols from rws where len(rows) >= 2 and list_max(list_transform(rows, lambda r: len(r))) >= 2 and len(list_filter(flatten(rows), lambda c: c <> '')) > 0),
ana as (select *, len(list_filter(flatten(rows), lambda c: c = '')) / greatest(len(flatten(rows)), 1) as share, n_cols <> list_min(list_transform(rows, lambda r: len(r))) as ragged,
  len(list_filter(rows[2], lambda c: c = '')) > len(rows[2]) // 2 and len(list_filter(rows[1], lambda c: c = '')) > 0 as multirow_header, len(list_filter(rows[1], lambda c: c = '')) as eh from tabs)"""


@query(f"with {_ROWS} select book_id, block_id, page, n_rows, n_cols, round_even(share, 3) as empty_ratio, ragged, multirow_header, ragged or multirow_header or share > 0.35 or eh > 0 as complex, n_rows > 40 as large from ana")
def table_analyse(spark: SparkSession, d: str) -> DataFrame:
    """Shape and faults of pipe tables."""
    return A.analysed_tables(table(spark, d, "blocks")).drop("rows")


_PADDED = "list_transform(rows, lambda r: list_concat(r, list_transform(range(n_cols - len(r)), lambda i: '')))"
_PIPES = f"list_transform({_PADDED}, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', chr(92) || '|')), ' | ') || ' |')"


@query(f"with {_ROWS} select book_id, block_id, array_to_string(list_concat(({_PIPES})[1:1], ['| ' || array_to_string(list_transform(range(n_cols), lambda i: '---'), ' | ') || ' |'], ({_PIPES})[2:]), chr(10)) as gfm from ana")
def table_gfm(spark: SparkSession, d: str) -> DataFrame:
    """Tables as pipe tables."""
    return A.analysed_tables(table(spark, d, "blocks")).select("book_id", "block_id", T.to_pipes(F.col("rows")).alias("gfm"))


_ESC = "replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(
    f"""with {_ROWS} select book_id, block_id, '<table>' || chr(10) || array_to_string(list_transform(rows, lambda r, i: '  <tr>' || array_to_string(list_transform(r, lambda c: case when i = 1 then '<th>' || {_ESC} || '</th>' else '<td>' || {_ESC} || '</td>' end), '') || '</tr>'), chr(10)) || chr(10) || '</table>' as html from ana"""
)
def table_html(spark: SparkSession, d: str) -> DataFrame:
    """Tables as HTML."""
    return A.analysed_tables(table(spark, d, "blocks")).select("book_id", "block_id", T.to_html(F.col("rows")).alias("html"))


@query(
    """with w as (select distinct book_id, page, block_seq as block, 1 as par, line_no as line, unnest(generate_series(1, len(string_split(text, ' ')))) as word_no, unnest(string_split(text, ' ')) as text, ((x0::int + line_no) % 101 - 1)::double as conf from page_lines where text is not null and spans is null),
    ok as (select * from w where conf >= 0 and trim(text) <> ''), l as (select book_id, page, block, par, line, string_agg(text, ' ' order by word_no) as t from ok group by all),
    t as (select book_id, page, string_agg(t, chr(10) order by block, par, line, t) as text from l group by all), c as (select book_id, page, round(avg(conf) / 100, 4) as confidence from ok group by all)
    select book_id, page, text, confidence from t join c using (book_id, page)"""
)
def ocr_gate(spark: SparkSession, d: str) -> DataFrame:
    """Recognised words as lines with confidence (S9, A16); lines of scanned pages stand for the recogniser's output."""
    lines = table(spark, d, "page_lines").where("text is not null and spans is null")
    words = lines.select("book_id", "page", F.col("block_seq").alias("block"), F.lit(1).alias("par"), F.col("line_no").alias("line"), F.posexplode(F.split("text", " ")).alias("word_no", "text"), ((F.bround("x0").cast("int") + F.col("line_no")) % 101 - 1).cast("double").alias("conf")).distinct()
    return A.recognised_lines(words)


@query("with p as (select book_id, page, coalesce(sum(length(text)) filter (where spans is not null), 0)::bigint as native_chars, count(*) filter (where spans is null) as images from (select distinct book_id, page, block_seq, line_no, text, spans from page_lines) group by all) select * from p where native_chars < 25 and (images > 0 or native_chars = 0)")
def ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose text has to be recognised (S9); lines without spans stand for pictures."""
    lines = table(spark, d, "page_lines").select("book_id", "page", "block_seq", "line_no", "text", "spans").distinct()
    pages = lines.groupBy("book_id", "page").agg(F.coalesce(F.sum(F.when(F.col("spans").isNotNull(), F.length("text"))), F.lit(0)).alias("native_chars"), F.count_if(F.col("spans").isNull()).alias("images"))
    return A.scanned_pages(pages)
