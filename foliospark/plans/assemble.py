"""Queries on the pass over a chapter's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import assemble as A
from foliospark.operators import chapters as C
from foliospark.plans.chapters import _HEADINGS, _books, _with_headings
from foliospark.plans.layout import _KIND, _OVERLAP, READING, STYLES
from foliospark.plans.registry import query
from foliospark.session import table

#: A book of two chapters that share a page, beside the tables: page, y, text, size, bold, italic; one line is one block.
_CASES = [
    (1, 60.0, "Chapter 10. Shared pages", 20.0, True, False), (1, 90.0, "A. Writer and B. Other", 10.0, False, True), (1, 120.0, "Text of the first chapter, long enough to set the size of the type", 10.0, False, False),
    (1, 200.0, "Figure 10.1 A long caption", 9.0, False, False), (1, 211.0, "that goes on", 9.0, False, False), (1, 214.0, "and ends here.", 9.0, False, False), (1, 215.0, "No more of it", 9.0, False, False),
    (1, 300.0, "KEY POINTS", 10.0, True, False), (1, 320.0, "The one point of it", 10.0, False, False), (1, 340.0, "Text behind the callout", 10.0, False, False),
    (1, 400.0, "References", 14.0, True, False), (1, 420.0, "1. Author. A book.", 10.0, False, False), (1, 440.0, "Author, continued", 10.0, False, False), (1, 500.0, "Another heading", 14.0, True, False), (1, 520.0, "Text below it", 10.0, False, False),
    (1, 700.0, "1 A note in small type", 7.0, False, False), (2, 60.0, "Tail of the first chapter", 10.0, False, False), (2, 400.0, "Chapter 11. The next one", 20.0, True, False), (2, 440.0, "Text of the second chapter", 10.0, False, False),
]


def _end(i: int) -> float:
    """The second block of a caption ends where the third begins, so that both stand right under it."""
    _, y, _, size, _, _ = _CASES[i]
    return {3: 210.0, 4: 213.0, 5: 214.5}.get(i, y + size)


_CASE_SQL = ", ".join(f"('cases', {p}, {i + 1}, 1, '{t}', 54.0, {y}, 300.0, {_end(i)}, {s}, {str(b).lower()}, {str(it).lower()})" for i, (p, y, t, s, b, it) in enumerate(_CASES))
_LINES = _HEADINGS.replace("from cur where title is not null and start_page is not null)", f"from cur where title is not null and start_page is not null union all select * from (values {_CASE_SQL}))", 1)
_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_CALL = r"(?i)^[\t-\r ]*(KEY POINTS?|KEY CONCEPTS?|CLINICAL PEARLS?|PEARLS?|IMPORTANT|CONTROVERSIES|SUMMARY|WARNING|CAUTION|NOTE|BOX [0-9][0-9.]*[^\n]{0,60})[\t-\r ]*:?[\t-\r ]*$"
_CAP = r"^[\t-\r ]*(Figure|Fig\.|Table)[\t-\r ]+([0-9]{1,4})(?:[.\-]([0-9]{1,3}))?(?:[^0-9A-Za-z_]|$)"
_BASE = rf"""{_LINES}, {STYLES}, {READING}, sty as (select book_id, page, block_seq, size as ssize, caps from styles),
shade as (select *, row_number() over (partition by book_id, page order by block_seq) as box_no from ({_KIND}'callout') where x1 - x0 > 100 and y1 - y0 > 30),
bx as (select a.book_id, a.page, a.block_seq, min(c.box_no)::int as box from b a join shade c on c.book_id = a.book_id and c.page = a.page and (a.x1 - a.x0) * (a.y1 - a.y0) > 0 and {_OVERLAP} >= 0.9 group by all),
fl as (select book_id, page, block_seq, trim(arg_min(text, line_no), ' ' || chr(9) || chr(10)) as first, arg_min(bold, line_no) as first_bold from l group by all),
ab as (select b.*, first, first_bold, body, ssize, caps, box, r.pos as in_page from b join fl using (book_id, page, block_seq) join reading r using (book_id, page, block_seq) join body using (book_id) left join sty using (book_id, page, block_seq) left join bx using (book_id, page, block_seq)),
cb as (select h.number as chapter, h.title, h.start_page, ab.*, row_number() over (partition by ab.book_id, h.number order by ab.page, in_page) as pos from headings h join ab on ab.book_id = h.book_id and ab.page between h.start_page and h.end_page),
tn as (select *, nullif(regexp_extract(replace(text, chr(10), ' '), '(?i)^[\t-\r ]*chapter[\t-\r ]+([0-9]{{1,9}})(?:[^0-9A-Za-z_]|$)', 1), '')::int as named, {_LETTERS.format('text')} as wl, {_LETTERS.format("coalesce(title, '')")} as tl, size >= 1.3 * body as large from cb),
ti as (select *, page = start_page and (coalesce(named = chapter, false) or (tl <> '' and length(wl) > 4 and (contains(tl, wl) or contains(wl, tl)) and large)) as is_title from tn),
fo as (select *, not is_title and coalesce(named <> chapter, false) and large and pos > 1 as alien from ti),
stp as (select *, min(case when alien then pos end) over (partition by book_id, chapter) as stop from fo),
beg as (select *, min(case when is_title and (stop is null or pos < stop) then pos end) over (partition by book_id, chapter) as begin_at from stp),
prt as (select *, case when pos >= stop then 'after' when pos < begin_at then 'before' when is_title then 'title' else 'in' end as part from beg),
rnk as (select *, case when ssize is not null and part in ('in', 'before') then least(5, dense_rank() over (partition by book_id, chapter order by ssize is null or part in ('title', 'after'), ssize desc, caps desc) + 1)::int end as level from prt),
fx as (select book_id, chapter, pos::int as pos, page, block_seq, y0, y1, coalesce(box, -1) as box, coalesce(level, 0) as level, part = 'title' as title, n_lines <= 2 and all_italic and length(text) < 120 as italic,
  size < 0.88 * body and y0 > 0.72 * 800.0 and regexp_matches(first, '^[\t-\r ]*(?:[0-9]{{1,2}}|[*†‡§])[\t-\r ]*[^\t-\r ]') as note, regexp_matches(first, '{_CAP}') as cap, n_lines <= 2 and not first_bold as plain, regexp_matches(rtrim(text), '[.)]$') as ends,
  regexp_matches(first, '{_CALL}') and (first_bold or (upper(first) = first and lower(first) <> first) or box is not null) as call, n_lines = 1 as alone, regexp_matches(replace(text, chr(10), ' '), '(?i)^[\t-\r ]*(references?|bibliography|suggested readings?|further reading)[\t-\r ]*$') as refhead,
  row_number() over (partition by book_id, chapter order by pos) as i from rnk where part in ('in', 'title')),
fold as (select book_id, chapter, 0::bigint as i, 0 as pos, 0 as page, 0 as block_seq, ''::varchar as k, ''::varchar as last, 0 as lpage, -1 as lbox, false as open, 0.0::double as ly1, false as lends, 0 as more, 0 as head, false as refs, false as titled, true as only_titles from (select distinct book_id, chapter from fx)
  union all select book_id, chapter, i, pos, page, block_seq, k, case when k = '+caption' then 'caption' when k like '+%' then 'callout' else k end, case when k like '+%' then lpage else page end, case when k like '+%' then lbox else box end,
    case when k = 'callout' then alone when k = '+box' then open else false end, case when k like '+%' then ly1 else y1 end, ends, case when k = '+caption' then more + 1 else 0 end, case when k like '+%' then head else pos end,
    case when k = 'heading' and refhead then true when k = 'heading' and level <= 2 then false else refs end, titled or k = 'title', only_titles and k = 'title'
  from (select x.*, f.last, f.lpage, f.lbox, f.open, f.ly1, f.lends, f.more, f.head, f.refs, f.titled, f.only_titles,
    case when x.title then 'title' when f.titled and f.only_titles and x.italic then 'byline' when x.note then 'footnote' when x.cap then 'caption'
      when f.last = 'caption' and f.lpage = x.page and x.plain and x.y0 - f.ly1 >= 0 and x.y0 - f.ly1 < 6.0 and not f.lends and f.more < 2 then '+caption' when x.call then 'callout'
      when f.last = 'callout' and f.lpage = x.page and x.box >= 0 and f.lbox = x.box then '+box' when f.last = 'callout' and f.lpage = x.page and f.open then '+open' when x.level > 0 then 'heading' when f.refs then 'reference' else 'body' end as k
    from fold f join fx x on x.book_id = f.book_id and x.chapter = f.chapter and x.i = f.i + 1)),
kinds as (select book_id, chapter, pos, page, block_seq, last as kind, head from fold where i > 0 union all select book_id, chapter, pos::int, page, block_seq, part, pos::int from prt where part in ('before', 'after'))"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = _with_headings(spark, d)
    cases = [("cases", p, i + 1, 1, t, 54.0, y, 300.0, _end(i), s, b, it) for i, (p, y, t, s, b, it) in enumerate(_CASES)]
    lines = lines.union(spark.createDataFrame(cases, lines.schema))
    boxes = table(spark, d, "blocks").where("block_type = 'callout' and x1 - x0 > 100 and y1 - y0 > 30").select("book_id", "page", "block_seq", "x0", "y0", "x1", "y1").distinct()
    boxes = boxes.withColumn("box_no", F.row_number().over(Window.partitionBy("book_id", "page").orderBy("block_seq")))
    return A.chapter_blocks(lines, C.from_headings(lines, _books(spark, d)), boxes)


@query(f"with recursive {_BASE} select * from kinds")
def chapter_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What each block of a chapter is, in order (W12-W15, P18, P19, P22-P24); callouts stand for shaded boxes, and a chapter's title for its heading."""
    return A.classified(_blocks(spark, d))


@query(
    f"""with recursive {_BASE}, t as (select k.book_id, k.chapter, k.head, k.kind, k.pos, cb.text from kinds k join cb on cb.book_id = k.book_id and cb.chapter = k.chapter and cb.pos = k.pos where kind not in ('before', 'after'))
    select book_id, chapter, head as pos, max(kind) as kind, count(*) as n, case when max(kind) = 'caption' then replace(string_agg(text, ' ' order by pos), chr(10), ' ') else string_agg(text, chr(10) order by pos) end as text from t group by book_id, chapter, head"""
)
def chapter_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of each chapter, captions and callouts with what goes on with them."""
    blocks = _blocks(spark, d)
    return A.merged(blocks, A.classified(blocks))


@query(f"with recursive {_BASE} select book_id, chapter, 'LOW' as severity, 'CHAPTER_BOUNDARY' as code, kind, min(page) as page, count(*) as n from kinds where kind in ('before', 'after') group by all")
def chapter_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """What is left out of a chapter since it belongs to another."""
    return A.boundary_issues(A.classified(_blocks(spark, d)))
