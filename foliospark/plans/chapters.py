"""Queries on chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.text import clean_title
from foliospark.operators import chapters as C
from foliospark.operators.quality import current_chapters
from foliospark.plans.layout import BLOCKS, BODY, LINES
from foliospark.plans.quality import CURRENT
from foliospark.plans.registry import joined, query
from foliospark.session import table

#: An outline made of the chapters (level 1, numbered titles for two books in three) and of their headings (level 2).
_TOC = f"""{CURRENT}, ent as (select book_id, 1 as level, case when right(book_id, 1)::int % 3 = 0 then title else 'Chapter ' || chapter || ': ' || title end as title, start_page as page, chapter as k from cur where title is not null
  union all select distinct book_id, 2, regexp_replace(raw_text, chr(10), ' ', 'g'), page, 1000000 + block_seq from blocks where block_type = 'heading' and raw_text is not null),
toc as (select book_id, level, title, page, row_number() over (partition by book_id order by page, level, k, title) as seq from ent)"""
_WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _clean(x: str) -> tuple[str, str]:
    t = f"regexp_replace(regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ +', ''), ' +$', '')"
    named, plain = r"(?i)^(?:chapter|ch\.?) ([0-9]{1,4})\b[ .:\-–—]*(.*)$", r"^([0-9]{1,4}) ?[.:\-–—]? +(.+)$"
    number = f"case when regexp_matches({t}, '{named}') then regexp_extract({t}, '{named}', 1) when regexp_matches({t}, '{plain}') then regexp_extract({t}, '{plain}', 1) end::int"
    title = f"case when regexp_matches({t}, '{named}') then coalesce(nullif(trim(regexp_extract({t}, '{named}', 2), ' .:-–—'), ''), {t}) when regexp_matches({t}, '{plain}') then trim(regexp_extract({t}, '{plain}', 2)) else {t} end"
    return number, title


_NO, _TITLE = _clean("title")
_OUTLINE = f"""{_TOC}, lv as (select book_id, level, count(*) as n, avg(case when {_NO} is not null then 1.0 else 0.0 end) as share from toc group by all),
pick as (select book_id, case when s1 > -0.8 and n1 >= 2 then case when s2 > s1 + 0.2 and n2 >= 2 then 2 else 1 end when s2 > -0.8 and n2 >= 2 then 2 else 1 end as level from
  (select book_id, max(share) filter (where level = 1) as s1, max(n) filter (where level = 1) as n1, max(share) filter (where level = 2) as s2, max(n) filter (where level = 2) as n2 from lv group by 1)),
bk as (select book_id, max(page_count) as page_count from books group by 1),
orows as (select t.*, page_count, lead(page) over w as following, row_number() over w as rn from toc t join pick using (book_id, level) join bk using (book_id) where page >= 1 window w as (partition by book_id order by seq)),
ochap as (select book_id, seq, coalesce({_NO}, rn)::int as number, {_TITLE} as title, page as start_page, least(greatest(page, coalesce(following - 1, page_count)), coalesce(page_count, 1073741824))::int as end_page,
  case when {_NO} is not null then 0.95::double else 0.8::double end as confidence from orows),
outline as (select * exclude k from (select *, row_number() over (partition by book_id, start_page, lower(title) order by seq) as k from ochap) where k = 1)"""


def _toc(spark: SparkSession, d: str) -> DataFrame:
    cur = current_chapters(table(spark, d, "chapters")).where("title is not null")
    title = F.when(F.right("book_id", F.lit(1)).cast("int") % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("Chapter "), "chapter", F.lit(": "), "title"))
    top = cur.select("book_id", F.lit(1).alias("level"), title.alias("title"), F.col("start_page").alias("page"), F.col("chapter").alias("k"))
    heads = table(spark, d, "blocks").where("block_type = 'heading' and raw_text is not null").select("book_id", F.lit(2).alias("level"), F.regexp_replace("raw_text", "\n", " ").alias("title"), "page", (1000000 + F.col("block_seq")).alias("k")).distinct()
    seq = F.row_number().over(Window.partitionBy("book_id").orderBy("page", "level", "k", "title"))
    return top.union(heads).select("book_id", "level", "title", "page", seq.alias("seq"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books").groupBy("book_id").agg(F.max("page_count").alias("page_count"))


def _outline(spark: SparkSession, d: str) -> DataFrame:
    return C.from_outline(_toc(spark, d), _books(spark, d))


@query(f"with {_OUTLINE} select book_id, number, title, start_page, end_page, confidence from outline")
def chapter_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of the outline and their pages."""
    return _outline(spark, d).drop("seq")


@query(f"select distinct book_id, {_NO} as number, {_TITLE} as clean from (select book_id, 'Ch. ' || number || ' - ' || title as title from chapters where number is not null union all select book_id, title from chapters where number is not null) where title is not null")
def chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and titles parted (P31): each title as it is, and with its number before it."""
    ch = table(spark, d, "chapters").where("title is not null and number is not null")
    number, clean = clean_title(F.col("t"))
    return ch.select("book_id", F.explode(F.array(F.concat(F.lit("Ch. "), "number", F.lit(" - "), "title"), "title")).alias("t")).select("book_id", number.alias("number"), clean.alias("clean")).distinct()


_VALID = f"""{CURRENT}, bk as (select book_id, max(page_count) as page_count from books group by 1),
vrows as (select c.book_id, c.chapter as number, c.title, c.start_page, least(c.end_page, coalesce(page_count, c.end_page)) as e, lead(c.start_page) over w as following, count(*) over (partition by c.book_id, c.chapter) > 1 as twice, c.confidence
  from cur c join bk using (book_id) window w as (partition by c.book_id order by c.start_page, c.chapter, c.title)),
vend as (select *, coalesce(e >= following and following > start_page, false) as trimmed from vrows),
vfin as (select *, case when trimmed then following - 1 else e end as end_page from vend)"""


@query(
    f"""with {_VALID} select book_id, number, title, start_page, end_page, least(confidence, case when twice then 0.4 end, case when end_page < start_page then 0.3 end) as confidence,
    array_to_string(list_filter([case when trimmed then 'end page trimmed to next chapter start' end, case when twice then 'duplicate chapter number' end, case when end_page < start_page then 'invalid page range' end], lambda x: x is not null), '|') as notes from vfin"""
)
def chapter_validate(spark: SparkSession, d: str) -> DataFrame:
    """Chapters with trimmed ends and confidence."""
    cur = current_chapters(table(spark, d, "chapters")).withColumnRenamed("chapter", "number")
    return joined(C.validate(cur, _books(spark, d)), "notes")


_FORM = r"(?i)^[\t-\r ]*(?:chapter|ch\.?)[\t-\r ]+([0-9]{1,4})(?:[^0-9A-Za-z_]|$)[\t-\r .:\-–—]*(.*)$"
#: Headings of books that have none stand in: the first heading of each chapter in large type.
_HLINES = f"""{LINES.replace('l as', 'l0 as')}, {CURRENT}, l as (select * from l0 union all select book_id, start_page, 0, 1, 'Chapter ' || chapter || '. ' || title, 54.0, case when chapter % 2 = 0 then 40.0 else 300.0 end, 400.0, case when chapter % 2 = 0 then 60.0 else 320.0 end, 24.0, true, false from cur where title is not null and start_page is not null)"""
_HEADINGS = f"""{_HLINES}, {BLOCKS.partition(', b as')[2].join(['b as', ''])}, {BODY}, bk as (select book_id, max(page_count) as page_count from books group by 1),
hb as (select *, regexp_replace(text, '[\\t-\\r ]+', ' ', 'g') as line from b join body using (book_id)),
hf as (select * from (select book_id, page, regexp_extract(line, '{_FORM}', 1)::int as number, trim(regexp_extract(line, '{_FORM}', 2), ' .:-–—') as title, y0 > 200.0 as mid_page, line as full_line, row_number() over (partition by book_id, page order by y0, block_seq) as k
  from hb where regexp_matches(line, '{_FORM}') and size >= body * 1.3) where k = 1),
headings as (select book_id, number, case when title = '' then full_line else title end as title, page as start_page, greatest(page, coalesce(case when lead(mid_page) over w then lead(page) over w else lead(page) over w - 1 end, page_count, page)) as end_page, mid_page,
  case when title = '' then 0.5::double else 0.8::double end as confidence from hf left join bk using (book_id) window w as (partition by book_id order by page))"""


def _with_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "page_lines").where("text is not null").select("book_id", "page", "block_seq", "line_no", "text", "x0", "y0", "x1", "y1", "size", "bold", "italic")
    cur = current_chapters(table(spark, d, "chapters")).where("title is not null and start_page is not null")
    y = F.when(F.col("chapter") % 2 == 0, 40.0).otherwise(300.0)
    return lines.union(cur.select("book_id", "start_page", F.lit(0), F.lit(1), F.concat(F.lit("Chapter "), "chapter", F.lit(". "), "title"), F.lit(54.0), y, F.lit(400.0), y + 20, F.lit(24.0), F.lit(True), F.lit(False)))


@query(f"with {_HEADINGS} select * from headings")
def chapter_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that begin with a large heading; those that begin in the middle of a page share it."""
    return C.from_headings(_with_headings(spark, d), _books(spark, d))


@query(
    f"""with {_OUTLINE.replace('with ', '')}, o as (select book_id, count(*) as o from outline group by 1), {_HEADINGS.replace(CURRENT + ', ', '').replace('bk as (select book_id, max(page_count) as page_count from books group by 1),', '')},
    h as (select book_id, count(*) as h from headings group by 1)
    select book_id, case when coalesce(o, 0) < 2 and coalesce(h, 0) > coalesce(o, 0) then 'heading-pattern' when coalesce(o, 0) > 0 then 'outline' else 'manual' end as source,
      case when coalesce(o, 0) < 2 and coalesce(h, 0) > coalesce(o, 0) then h when coalesce(o, 0) > 0 then o else 1 end as chapters from (select distinct book_id from books) left join o using (book_id) left join h using (book_id)"""
)
def chapter_detect(spark: SparkSession, d: str) -> DataFrame:
    """How the chapters of each book are found."""
    return C.detect(_outline(spark, d), C.from_headings(_with_headings(spark, d), _books(spark, d)), _books(spark, d))


@query(f"with {CURRENT} select p.book_id, c.chapter as number, p.page from (select distinct book_id, page from page_lines) p join cur c on c.book_id = p.book_id and p.page between c.start_page and c.end_page")
def chapter_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each chapter."""
    cur = current_chapters(table(spark, d, "chapters")).withColumnRenamed("chapter", "number")
    return C.pages_of(cur, table(spark, d, "page_lines"))


@query(
    r"""with p as (select distinct book_id, page, block_seq, line_no, text from page_lines where text is not null and page <= 30),
    s as (select book_id, round(avg(case when n > 40 then 1.0 else 0.0 end), 6) as native_share from (select book_id, page, sum(length(trim(text))) as n from p group by all) group by 1),
    e as (select book_id, arg_min(regexp_extract(text, '(?i)([0-9]{1,2})(?:st|nd|rd|th) edition', 1), (page, block_seq, line_no)) as edition_no from p where page <= 3 and regexp_matches(text, '(?i)([0-9]{1,2})(?:st|nd|rd|th) edition') group by 1),
    n as (select book_id, count(distinct page) as pages from page_lines group by 1)
    select book_id, coalesce(nullif(trim(title), ''), slug) as title, edition_no, native_share, pages from books left join s using (book_id) left join e using (book_id) left join n using (book_id)"""
)
def book_inspect(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a book at first sight."""
    return C.inspect(table(spark, d, "books"), table(spark, d, "page_lines"))
