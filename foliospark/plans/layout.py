"""Queries on page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import layout as Y
from foliospark.operators.lines import unique_lines
from foliospark.plans.registry import joined, query
from foliospark.session import table

LINES = "l as (select distinct book_id, page, block_seq, line_no, text, x0, y0, x1, y1, size, bold, italic from page_lines where text is not null)"
BLOCKS = f"""{LINES}, b as (select book_id, page, block_seq, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n_lines, max(size) as size,
  bool_and(bold) as all_bold, bool_and(italic) as all_italic, string_agg(text, chr(10) order by line_no) as text from l group by all)"""
BODY = "body as (select book_id, arg_max(s, (n, -s)) as body from (select book_id, round_even(size * 2, 0) / 2 as s, sum(length(text)) as n from l group by all) group by book_id)"
_BULLET = r"^[\t-\r ]*(?:[•●▪■◦·‣○]|[-–—*][\t-\r ])"
_NUMBERED = r"^[\t-\r ]*[0-9]{1,2}[.)][\t-\r ]+[^\t-\r ]"
_CAPTION = r"^[\t-\r ]*(Figure|Fig\.|Table)[\t-\r ]+([0-9]{1,4})(?:[.\-]([0-9]{1,3}))?(?:[^0-9A-Za-z_]|$)"
STYLES = f"""styles as (select book_id, page, block_seq, s as size, upper(t) = t and lower(t) <> t as caps, big, case when big then 0.92::double else 0.8::double end as confidence from (select *, s >= body * 1.12 as big from
  (select *, trim(replace(text, chr(10), ' ')) as t, round_even(size * 2, 0) / 2 as s from b join body using (book_id)))
  where n_lines <= 3 and length(t) between 1 and 160 and not regexp_matches(t, '{_BULLET}') and not (all_italic and not all_bold) and (big or (all_bold and s >= body * 0.98))
  and not regexp_matches(t, '[,;]$') and (big or not regexp_matches(t, '[.]$')) and not regexp_matches(t, '{_CAPTION}') and not regexp_matches(t, '{_NUMBERED}') and (big or (n_lines <= 2 and length(t) <= 100)))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_lines")


def _kinds(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "blocks").where(F.col("block_type") == kind).select("book_id", "page", "block_seq", "x0", "y0", "x1", "y1").distinct()


READING = """rp as (select book_id, page, count(*) filter (where x1 - x0 < 428.4 and x1 <= 330.48) as nl, count(*) filter (where x1 - x0 < 428.4 and x0 >= 281.52) as nr,
  count(*) filter (where x1 - x0 < 428.4 and x0 < 281.52 and x1 > 330.48) as na, count(*) filter (where x1 - x0 < 428.4) as n,
  max(x1) filter (where x1 - x0 < 428.4 and x1 <= 330.48) as lx, min(x0) filter (where x1 - x0 < 428.4 and x0 >= 281.52) as rx from b group by all),
rg as (select b.*, case when nl >= 1 and nr >= 1 and nl + nr >= 3 and na <= greatest(1, floor(n / 10)) and rx - lx >= 8 then (lx + rx) / 2 end as gutter from b join rp using (book_id, page)),
rc as (select *, coalesce(x0 < gutter - 24.48 and x1 > gutter + 24.48, false) as is_full from rg),
rk as (select *, case when gutter is null or is_full then 0 when (x0 + x1) / 2 < gutter then 1 else 2 end as col, sum(is_full::int) over (partition by book_id, page order by y0, x0, block_seq) as band from rc),
reading as (select book_id, page, block_seq, round(gutter, 3) as gutter, col, row_number() over (partition by book_id, page order by band, col, y0, x0, block_seq) - 1 as pos from rk)"""


@query(f"with {BLOCKS}, {READING} select * from reading")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Reading order of the blocks of each page."""
    return Y.reading_order(Y.blocks_of(_lines(spark, d)))


_OVERLAP = "greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0))"
_KIND = "select distinct book_id, page, block_seq, x0, y0, x1, y1 from blocks where block_type = "


@query(f"with {BLOCKS} select book_id, page, block_seq from b a where not exists (select 1 from ({_KIND}'table') c where c.book_id = a.book_id and c.page = a.page and (a.x1 - a.x0) * (a.y1 - a.y0) > 0 and {_OVERLAP} >= 0.5)")
def blocks_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks that don't lie in a table."""
    return Y.outside(Y.blocks_of(_lines(spark, d)), _kinds(spark, d, "table"), ["block_seq"])


@query(
    f"""with {LINES} select book_id, page, block_seq, line_no from l a where not exists (select 1 from ({_KIND}'heading') c where c.book_id = a.book_id and c.page = a.page
    and (a.x0 + a.x1) / 2 between c.x0 - 1 and c.x1 + 1 and (a.y0 + a.y1) / 2 between c.y0 - 1 and c.y1 + 1)"""
)
def words_outside_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose centre lies in no excluded box; headings stand for the excluded ones."""
    return Y.centre_outside(unique_lines(_lines(spark, d)), _kinds(spark, d, "heading"), ["block_seq", "line_no"])


@query(
    f"""with {LINES}, c as (select *, row_number() over (partition by book_id, page order by block_seq) as box_no from ({_KIND}'callout')
      where x1 - x0 > 100 and y1 - y0 > 30)
    select a.book_id, a.page, a.block_seq, a.line_no, min(c.box_no) as box from l a left join c on c.book_id = a.book_id and c.page = a.page and (a.x1 - a.x0) * (a.y1 - a.y0) > 0 and {_OVERLAP} >= 0.9 group by all"""
)
def shaded_box(spark: SparkSession, d: str) -> DataFrame:
    """The first shaded box that holds each line; callouts stand for the boxes."""
    from pyspark.sql import Window

    shaded = _kinds(spark, d, "callout").where("x1 - x0 > 100 and y1 - y0 > 30").withColumn("box_no", F.row_number().over(Window.partitionBy("book_id", "page").orderBy("block_seq")))
    return Y.first_box(unique_lines(_lines(spark, d)), shaded, ["block_seq", "line_no"])


@query(f"with {LINES}, {BODY} select * from body")
def body_font_size(spark: SparkSession, d: str) -> DataFrame:
    """Font size of the running text of each book (A2)."""
    return Y.body_size(_lines(spark, d))


@query("select book_id, page, list_sort(list(size))[len(list(size)) // 2 + 1] as median from (select book_id, page, unnest(list_transform(spans, lambda s: s.size)) as size from (select distinct book_id, page, block_seq, line_no, spans from page_lines where spans is not null)) group by all")
def page_median_size(spark: SparkSession, d: str) -> DataFrame:
    """Upper median of the span sizes of each page."""
    return Y.page_median_size(_lines(spark, d))


@query(
    f"""with {LINES}, w as (select *, lag(text) over o as pt, lag(bold) over o as pb, lag(size) over o as ps from l window o as (partition by book_id, page, block_seq order by line_no)),
    f as (select *, coalesce(((bold and pb and (upper(text) = text and lower(text) <> text) <> (upper(pt) = pt and lower(pt) <> pt)) or abs(size - ps) > 1.0 or (bold <> pb and ((length(text) < 100 and length(pt) < 100) or bold)))::int, 0) as new from w),
    g as (select *, sum(new) over (partition by book_id, page, block_seq order by line_no)::bigint as part from f)
    select book_id, page, block_seq, part, min(line_no) as first_line, max(line_no) as last_line from g group by all"""
)
def style_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks parted where the style of their lines changes (S3)."""
    return Y.style_blocks(_lines(spark, d))


@query(f"with {BLOCKS}, {BODY}, {STYLES} select * from styles")
def heading_style(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that look like headings."""
    return Y.heading_styles(_lines(spark, d))


@query(f"with {BLOCKS}, {BODY}, {STYLES} select book_id, size, caps, count(*) as n, least(5, dense_rank() over (partition by book_id order by size desc, caps desc) + 1)::int as level from styles group by book_id, size, caps")
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the heading styles of each book (A4)."""
    return Y.heading_levels(Y.heading_styles(_lines(spark, d)))


@query(
    f"""with {BLOCKS}, k as (select book_id, page, block_seq as seq, text, x0, y0, x1, y1, size, case when regexp_matches(text, '^(Figure|Fig\\.) [0-9]') then 'caption' when length(text) > 200 then 'fragment' else 'text' end as kind from b),
    c0 as (select * from k where kind = 'caption'),
    c as (select c0.*, greatest(c0.y1 - 330, coalesce((select max(o.y1) from c0 o where o.book_id = c0.book_id and o.page = c0.page and o.seq <> c0.seq and o.y1 <= c0.y0 and least(c0.x1, o.x1) - greatest(c0.x0, o.x0) > 0.5 * least(c0.x1 - c0.x0, o.x1 - o.x0)), c0.y1 - 330)) as low from c0),
    f as (select c.book_id, c.page, c.seq as cap, f.seq as frag, f.x0, f.y0, f.x1, f.y1, row_number() over (partition by f.book_id, f.page, f.seq order by c.seq) as n from c join k f on f.book_id = c.book_id and f.page = c.page and f.kind = 'fragment' and f.y1 <= c.y1 + 15 and f.y0 >= c.low),
    g as (select book_id, page, cap, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*)::int as fragments from f where n = 1 group by all having max(x1) - min(x0) >= 40 and max(y1) - min(y0) >= 10),
    sz as (select book_id, page, round_even(size * 2, 0) / 2 as s, sum(length(text)) as n from k where kind in ('text', 'caption') group by all), body as (select book_id, page, arg_max(s, (n, -s)) as body from sz group by all),
    t as (select g.book_id, g.page, g.cap, t.seq, t.text, t.x0, t.y0, row_number() over (partition by t.book_id, t.page, t.seq order by g.cap) as n
      from g join c on c.book_id = g.book_id and c.page = g.page and c.seq = g.cap join body on body.book_id = g.book_id and body.page = g.page join k t on t.book_id = g.book_id and t.page = g.page and t.kind = 'text'
      where t.y1 <= c.y1 + 15 and t.x0 >= g.x0 - 50 and t.x1 <= (case when c.x0 >= g.x1 - 5 then greatest(g.x1, c.x1) + 5 else g.x1 + 15 end) and not (t.x0 >= c.x0 - 1 and t.y0 >= c.y0 - 1 and t.y1 <= c.y1 + 1)
      and (t.y0 >= g.y0 - 12 or (t.y0 >= g.y0 - 30 and (t.size < body * 0.95 or (t.y1 - t.y0 < 14 and t.y0 > c.low))))),
    q as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from t where n = 1),
    pt as (select book_id, page, cap, round_even(y0 / 4, 0) as ry, x0, seq, case when len(list_filter(ls, lambda x: regexp_matches(x, '^[•●▪■◦·‣○]'))) > 0
      then list_transform(string_split(regexp_replace(array_to_string(ls, chr(10)), chr(10) || '([•●▪■◦·‣○])', chr(1) || '\\1', 'g'), chr(1)), lambda x: replace(regexp_replace(x, '^[•●▪■◦·‣○][\t-\r ]*', ''), chr(10), ' ')) else [array_to_string(ls, ' ')] end as parts from q),
    lab as (select book_id, page, cap, array_to_string(flatten(list(parts order by ry, x0, seq)), '|') as labels from pt group by all)
    select g.book_id, g.page, g.cap as caption_seq, g.fragments, coalesce(labels, '') as labels from g left join lab using (book_id, page, cap) where labels is not null or fragments >= 3"""
)
def composite_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures made of fragments and labels, by the size of most characters of the page (A3, J12, T7): captions of the pages, with the text blocks around them as fragments and labels."""
    b = Y.blocks_of(_lines(spark, d)).select("book_id", "page", F.col("block_seq").alias("seq"), "text", "x0", "y0", "x1", "y1", "size")
    kind = F.when(F.col("text").rlike("^(Figure|Fig\\.) [0-9]"), "caption").when(F.length("text") > 200, "fragment").otherwise("text")
    b = b.withColumn("kind", kind)
    pages = b.where("kind = 'caption'").select("book_id", "page").distinct()
    return joined(Y.composite_figures(b.join(pages, ["book_id", "page"], "left_semi")), "labels")
