"""Queries on the structure of chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from foliospark.operators import layout as Y
from foliospark.operators import structure as S
from foliospark.operators.quality import current_chapters
from foliospark.plans.layout import BLOCKS, BODY, LINES
from foliospark.plans.quality import CURRENT
from foliospark.plans.registry import joined, query
from foliospark.session import table

ITEMS = "items as (select distinct book_id, chapter, ord, kind, md, page, x0, y0, x1, y1, block_id, raw, cleaned, confidence, level, section_id from out_items)"
_LEVELS = ", ".join(
    f"last_value(case when h = {i} then {{o: ord, t: t}} end ignore nulls) over w as own{i}, max(case when h < {i} then ord end) over w as less{i}" for i in range(1, 7)
)
_PATH = "list_filter([" + ", ".join(f"case when own{i} is not null and (less{i} is null or own{i}.o > less{i}) then own{i}.t end" for i in range(1, 7)) + "], lambda x: x is not null)"
PATHS = f"""{ITEMS}, hi as (select *, case when kind = 'heading' and level > 0 then level end as h, regexp_extract(md, '^#{{1,6}} ([^\\n]*)', 1) as t from items),
pw as (select *, {_LEVELS} from hi window w as (partition by book_id, chapter order by ord rows between unbounded preceding and current row)),
paths as (select book_id, chapter, ord, {_PATH} as path from pw)"""


# The forms of lines once more, for the SQL side alone.
_BUL = r"^\s*([•●▪■◦·‣○]|[-–—*]\s)"
_NUM = r"^\s*\d{1,2}[.)]\s+\S"
_LET = r"^\s*(\(?[a-z]\)|\([ivx]+\))\s+\S"
_CAP = r"^\s*(Figure|Fig\.|Table)\s+(\d{1,4})(?:[.\-](\d{1,3}))?\b"
_REF = r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})[.)])\s+(\S.*)$"
_CALL = r"(?i)^\s*(key points?|key concepts?|clinical pearls?|pearls?|important|controversies|summary|warning|caution|note|box \d[\d.]*[^\n]{0,60})\s*:?\s*$"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return S.ordered_items(table(spark, d, "out_items"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_lines")


@query(f"with {PATHS} select book_id, chapter, ord, array_to_string(path, '|') as path from paths")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """Headings above each item."""
    return joined(S.heading_paths(_items(spark, d)), "path")


_SLUG70 = "trim(left(lower(trim(regexp_replace(regexp_replace(array_to_string(path[greatest(len(path) - 1, 1):], '-'), '[^\\x{0}-\\x{7F}]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '-')), 70), '-')"


@query(
    f"""with {PATHS}, base as (select p.book_id, p.chapter, p.ord, slug || '-ch' || p.chapter || '-' || coalesce(nullif({_SLUG70}, ''), 'untitled') as base
      from paths p join items i using (book_id, chapter, ord) join (select book_id, min(slug) as slug from books group by 1) k using (book_id) where i.kind = 'heading')
    select book_id, chapter, ord, case when n = 1 then base else base || '-' || n end as section_id from (select *, row_number() over (partition by book_id, chapter, base order by ord) as n from base)"""
)
def section_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of sections."""
    items = _items(spark, d)
    return S.section_ids(S.with_paths(items).where("kind = 'heading'"), table(spark, d, "books"))


@query(
    rf"""with {LINES}, m as (select *, min(x0) over (partition by book_id, page, block_seq) as lft, regexp_matches(text, '{_BUL}') or regexp_matches(text, '{_NUM}') or regexp_matches(text, '{_LET}') as item,
      rtrim(lag(text) over o) as before, lag(x0) over o as px, lag(y1) over o as py from l window o as (partition by book_id, page, block_seq order by line_no)),
    f as (select *, case when px is null or item or coalesce(y0 - py > 0.6 * size, false) or (x0 - lft > 6 and px - lft < 3 and regexp_matches(before, '\.$')) then 1 else 0 end as new from m),
    g as (select *, sum(new) over (partition by book_id, page, block_seq order by line_no)::bigint as group_no from f)
    select book_id, page, block_seq, group_no, arg_min(case when item then 'item' else 'para' end, line_no) as kind,
      (arg_min({{m: case when regexp_matches(text, '{_NUM}') then regexp_extract(text, '^[\t-\r ]*([0-9]{{1,2}})[.)]', 1) || '.' when item then '-' end}}, line_no)).m as marker,
      (arg_min({{i: case when item then greatest(round_even((x0 - lft) / 14, 0), 0)::int end}}, line_no)).i as indent, min(line_no) as first_line, count(*) as n_lines from g group by all"""
)
def list_groups(spark: SparkSession, d: str) -> DataFrame:
    """List items and paragraphs of each block."""
    return S.list_groups(_pages(spark, d))


_MERGES = [(1, "paragraph", "A sentence that goes on"), (2, "paragraph", "in the next item and"), (3, "paragraph", "in a third one."), (4, "paragraph", "ends here."), (5, "list", "no end"), (6, "paragraph", "not after a list"), (7, "paragraph", "Äpfel und"), (8, "paragraph", "ähnliches")]
_MERGE_SQL = ", ".join(f"('cases', 1, {o}, '{k}', '{t}')" for o, k, t in _MERGES)


@query(
    rf"""with items as (select book_id, chapter, ord, kind, md from (select distinct book_id, chapter, ord, kind, md, page, x0, y0, x1, y1, block_id, raw, cleaned, confidence, level, section_id from out_items) union all select * from (values {_MERGE_SQL})),
    w as (select *, lag(kind) over o as pk, lag(md) over o as pm from items window o as (partition by book_id, chapter order by ord)),
    f as (select *, coalesce(kind = 'paragraph' and pk = 'paragraph' and regexp_matches(md, '^[a-zà-öø-ÿ]') and not contains(md, chr(10)) and not contains(pm, chr(10)) and not regexp_matches(rtrim(pm), '[.!?:;)\]"''”’]$'), false) as goes_on from w),
    g as (select *, sum(case when goes_on then 0 else 1 end) over (partition by book_id, chapter order by ord) as island from f)
    select book_id, chapter, min(ord) as first_ord, count(*) as n, string_agg(ord::varchar, '|' order by ord) as ords from g group by book_id, chapter, island having count(*) > 1"""
)
def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that go on in the next item (W11); with some literal items, since the tables hold none."""
    cases = spark.createDataFrame([("cases", 1, *x) for x in _MERGES], "book_id STRING, chapter INT, ord INT, kind STRING, md STRING")
    return joined(S.paragraph_merge(_items(spark, d).select(*cases.columns).union(cases)), "ords")




@query(
    rf"""with {LINES}, c as (select book_id, page, block_seq, line_no, text, bold from l union all select distinct book_id, page, block_seq, 0, regexp_extract(markdown, '^> \*\*([^*]+)\*\*', 1), true from blocks where block_type = 'callout' and markdown is not null),
    f as (select book_id, page, block_seq, arg_min(text, line_no) as t, arg_min(bold, line_no) as b, count(*) as n_lines from c group by all)
    select book_id, page, block_seq, upper(trim(regexp_extract(t, '{_CALL}', 1))) as label, n_lines = 1 as open from f where regexp_matches(t, '{_CALL}') and (b or (upper(t) = t and lower(t) <> t))"""
)
def callouts(spark: SparkSession, d: str) -> DataFrame:
    """Callout blocks (P18). The lines of the tables lack the names, so they come from the Markdown."""
    named = table(spark, d, "blocks").where("block_type = 'callout' and markdown is not null")
    name = F.regexp_extract("markdown", r"^> \*\*([^*]+)\*\*", 1)
    lines = _pages(spark, d).select("book_id", "page", "block_seq", "line_no", "text", "x0", "y0", "x1", "y1", "size", "bold", "italic")
    return S.callouts(lines.union(named.select("book_id", "page", "block_seq", F.lit(0), name, "x0", "y0", "x1", "y1", F.lit(10.0), F.lit(True), F.lit(False))))


@query(
    rf"""with {BLOCKS}, w as (select *, coalesce(lead(n_lines) over o <= 2 and not lead(all_bold) over o and lead(y0) over o - y1 >= 0 and lead(y0) over o - y1 < 6 and not regexp_matches(rtrim(text), '[.)]$'), false) as continued
      from b window o as (partition by book_id, page order by block_seq))
    select book_id, page, block_seq, regexp_extract(text, '{_CAP}', 1) as what, regexp_extract(text, '{_CAP}', 2)::int as chapter, nullif(regexp_extract(text, '{_CAP}', 3), '')::int as no, continued from w where regexp_matches(text, '{_CAP}')"""
)
def captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions, and whether the next block looks like going on with them (P19); ``chapter_items`` joins them."""
    return S.captions(_pages(spark, d))


_SIGN = r"^[\t-\r ]*([0-9]{1,2}|[*†‡§])[\t-\r ]*[^\t-\r ]"


@query(
    f"""with {BLOCKS}, {BODY}, f as (select *, regexp_extract(text, '{_SIGN}', 1) as mark from b join body using (book_id) where size < body * 0.88 and y0 > 800.0 * 0.72 and regexp_matches(text, '{_SIGN}'))
    select book_id, page, block_seq, case when regexp_matches(mark, '^[0-9]') then 'p' || page || 'n' || mark else 'p' || page || 's' || row_number() over (partition by book_id, page order by block_seq) end as label from f"""
)
def footnotes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in small type low on a page that begin with a number or sign."""
    return S.footnotes(_pages(spark, d), Y.body_size(_pages(spark, d)))


@query(
    f"""with {ITEMS}, i as (select *, regexp_replace(md, '\\[([0-9]{{1,2}})\\]', '<sup>\\1</sup>', 'g') as m from items where kind in ('paragraph', 'list') and md is not null),
    n as (select distinct book_id, page, unnest(regexp_extract_all(m, '<sup>([0-9]+)</sup>', 1)) as n from i), ns as (select book_id, page, list(n order by n) as ns from n group by all),
    f as (select i.*, list_reduce(list_concat([m], ns), lambda t, x: regexp_replace(t, '<sup>' || x || '</sup>', '[^p' || page || 'n' || x || ']')) as linked from i join ns using (book_id, page))
    select book_id, chapter, ord, linked from f where linked <> m"""
)
def footnote_links(spark: SparkSession, d: str) -> DataFrame:
    """Raised numbers linked to the footnotes of their page (J6); raised numbers and notes are derived from citations."""
    items = _items(spark, d).where("kind in ('paragraph', 'list') and md is not null").withColumn("md", F.regexp_replace("md", r"\[([0-9]{1,2})\]", "<sup>$1</sup>"))
    notes = items.select("book_id", "page", F.explode(F.regexp_extract_all("md", F.lit("<sup>([0-9]+)</sup>"), F.lit(1))).alias("n")).distinct()
    notes = notes.select("book_id", "page", F.concat(F.lit("p"), "page", F.lit("n"), "n").alias("label"))
    return S.link_footnotes(items, notes).select("book_id", "chapter", "ord", "linked").where("linked <> md")


@query(
    rf"""with r as (select distinct book_id, regexp_extract(block_id, '^ch([0-9]+)-', 1)::int as chapter, block_id, raw_text from blocks where block_type = 'reference' and raw_text is not null),
    l as (select book_id, chapter, block_id, generate_subscripts(string_split(raw_text, chr(10)), 1) as pos, unnest(string_split(raw_text, chr(10))) as line from r),
    f as (select *, regexp_matches(line, '{_REF}') as begins, sum(regexp_matches(line, '{_REF}')::int) over (partition by book_id, block_id order by pos)::bigint as entry from l)
    select book_id, chapter, block_id, entry, max(case when begins then coalesce(nullif(regexp_extract(line, '{_REF}', 1), ''), nullif(regexp_extract(line, '{_REF}', 2), ''))::int end) as no,
      string_agg(case when begins then regexp_extract(line, '{_REF}', 3) else trim(line) end, ' ' order by pos) as text from f group by all"""
)
def reference_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the reference lists."""
    return S.reference_entries(table(spark, d, "blocks"))


_XREF = r"\b((Chapter|Chap\.|Table|Fig\.|Figure)\s+(\d{1,4})(?:\.(\d{1,3}))?)"
XREFS = rf"""{ITEMS}, xr as (select book_id, chapter, ord, page, unnest(regexp_extract_all(md, '{_XREF}', 1)) as text, unnest(regexp_extract_all(md, '{_XREF}', 2)) as kind, unnest(regexp_extract_all(md, '{_XREF}', 3))::int as target_chapter,
  nullif(unnest(regexp_extract_all(md, '{_XREF}', 4)), '')::int as target_no from items where kind in ('paragraph', 'list', 'callout', 'caption') and md is not null),
{CURRENT}, conv as (select book_id, chapter, 'ch_' || lpad(chapter::varchar, 3, '0') || '.md' as file from cur),
resolved as (select x.*, case when c.file is not null then '[' || x.text || '](' || c.file || case when x.target_no is null or x.kind not in ('Table', 'Fig.', 'Figure') then '' else '#' || case when x.kind = 'Table' then 'table' else 'figure' end || '-' || x.target_chapter || '-' || x.target_no end || ')' end as link
  from xr x left join conv c on c.book_id = x.book_id and c.chapter = x.target_chapter and not (x.target_chapter = x.chapter and x.kind like 'Chap%') where not (x.target_chapter = x.chapter and x.kind not like 'Chap%'))"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    cur = current_chapters(table(spark, d, "chapters"))
    conv = cur.select("book_id", "chapter", F.concat(F.lit("ch_"), F.lpad(F.col("chapter").cast("string"), 3, "0"), F.lit(".md")).alias("file"))
    return S.resolve(S.cross_references(_items(spark, d)), conv)


@query(f"with {XREFS} select * from resolved where link is not null")
def xref_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Cross-references as links to the chapters of the book."""
    return _resolved(spark, d).where("link is not null")


@query(f"with {XREFS} select book_id, chapter as from_chapter, target_chapter, kind, count(*) as n, min(page) as first_page from resolved where link is null group by all")
def xref_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Cross-references to chapters that the book doesn't have."""
    rows = _resolved(spark, d).where("link is null")
    return rows.groupBy("book_id", F.col("chapter").alias("from_chapter"), "target_chapter", "kind").agg(F.count("*").alias("n"), F.min("page").alias("first_page"))


@query(
    f"""with {ITEMS}, xr as (select book_id, chapter, ord, unnest(regexp_extract_all(md, '{_XREF}', 1)) as text, unnest(regexp_extract_all(md, '{_XREF}', 3))::int as target_chapter from items where kind in ('paragraph', 'list', 'callout', 'caption') and md is not null),
    wr as (select book_id, chapter, ord, min(written_at) as written_at from out_items group by all), c as (select book_id, number as target_chapter, min(added_at) as added_at from chapters where number is not null group by all)
    select x.book_id, x.chapter, x.ord, x.text, x.target_chapter, 'ch_' || lpad(x.target_chapter::varchar, 3, '0') || '.md' as file from xr x join wr using (book_id, chapter, ord) join c using (book_id, target_chapter) where x.chapter <> x.target_chapter and c.added_at > wr.written_at"""
)
def xref_relink(spark: SparkSession, d: str) -> DataFrame:
    """Cross-references to chapters that came after the item was written, and find them now."""
    at = table(spark, d, "out_items").groupBy("book_id", "chapter", "ord").agg(F.min("written_at").alias("written_at"))
    added = table(spark, d, "chapters").where("number is not null").groupBy("book_id", F.col("number").alias("target_chapter")).agg(F.min("added_at").alias("added_at"))
    return S.relinked(S.cross_references(_items(spark, d)), at, added).select("book_id", "chapter", "ord", "text", "target_chapter", "file")


_NEAR = """nb as (select *, lead(ord, 1) over w as o1, lead(ord, 2) over w as o2, lead(ord, 3) over w as o3, lag(ord, 1) over w as b1, lag(ord, 2) over w as b2 from mi window w as (partition by book_id, chapter order by ord)),
cap as (select book_id, chapter, ord, page, md from mi where kind = 'caption'),
want as (select book_id, chapter, ord, kind, page, unnest(case kind when 'figure' then [o1, o2, o3, b1, b2] else [b1, o1] end) as c, unnest(case kind when 'figure' then [1, 2, 3, 4, 5] else [1, 2] end) as pref from nb where kind in ('figure', 'table')),
may as (select w.book_id, w.chapter, w.ord, list(w.c order by w.pref) as choices from want w join cap on cap.book_id = w.book_id and cap.chapter = w.chapter and cap.ord = w.c
  where (w.kind = 'figure' and cap.md like 'Fig%' and cap.page = w.page) or (w.kind = 'table' and cap.md like 'Table%') group by all),
seq as (select n.book_id, n.chapter, n.ord, n.kind, coalesce(choices, []) as choices, row_number() over (partition by n.book_id, n.chapter order by n.ord) as i from nb n left join may using (book_id, chapter, ord) where n.kind in ('figure', 'table')),
fold as (select book_id, chapter, i, ord, kind, choices[1] as got, [coalesce(choices[1], -1)] as taken from seq where i = 1
  union all select s.book_id, s.chapter, s.i, s.ord, s.kind, list_filter(s.choices, lambda x: not list_contains(f.taken, x))[1], list_append(f.taken, coalesce(list_filter(s.choices, lambda x: not list_contains(f.taken, x))[1], -1)) from fold f join seq s on s.book_id = f.book_id and s.chapter = f.chapter and s.i = f.i + 1),
pairs as (select book_id, chapter, ord, kind, got as caption_ord from fold)"""
#: The item before each figure caption stands for its picture.
_FIGURES = "mi as (select * replace (case when kind = 'paragraph' and lead(kind) over w = 'caption' and lead(md) over w like 'Fig%' then 'figure' else kind end as kind) from items window w as (partition by book_id, chapter order by ord))"


def _with_figures(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    w = Window.partitionBy("book_id", "chapter").orderBy("ord")
    figure = (F.col("kind") == "paragraph") & (F.lead("kind").over(w) == "caption") & F.lead("md").over(w).startswith("Fig")
    return items.withColumn("kind", F.when(figure, "figure").otherwise(F.col("kind")))


@query(f"with recursive {ITEMS}, mi as (select * from items), {_NEAR} select * from pairs where kind = 'table'")
def caption_assoc_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables with their captions."""
    return S.match_captions(_items(spark, d)).where("kind = 'table'")


@query(f"with recursive {ITEMS}, {_FIGURES}, {_NEAR} select * from pairs where kind = 'figure'")
def caption_assoc_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures with their captions (J4); the item before each figure caption stands for its picture."""
    return S.match_captions(_with_figures(spark, d)).where("kind = 'figure'")


@query(
    rf"""with recursive {ITEMS}, {_FIGURES}, {_NEAR}, m as (select p.*, c.md, nullif(regexp_extract(c.md, '{_CAP}', 3), '')::int as no, row_number() over (partition by p.book_id, p.chapter, p.kind order by p.ord) as place from pairs p left join cap c on c.book_id = p.book_id and c.chapter = p.chapter and c.ord = p.caption_ord),
    n as (select book_id, chapter, ord, kind, caption_ord, case when md is not null and (kind = 'figure' or no is not null) then regexp_extract(md, '{_CAP}', 2)::int::varchar || coalesce('_' || lpad(no::varchar, 2, '0'), '') else chapter || '_' || lpad(place::varchar, 2, '0') end as number from m),
    k as (select *, row_number() over (partition by book_id, chapter, kind, number order by ord) as k from n)
    select book_id, chapter, ord, kind, caption_ord, number, kind || '_' || number || case when k > 1 then '_' || k else '' end || case kind when 'figure' then '.png' else '.md' end as file from k"""
)
def figure_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and file names of figures and tables (W20, K11); the item before each figure caption stands for its picture."""
    return S.figure_numbers(_with_figures(spark, d))


@query(
    f"""with recursive {ITEMS}, {_FIGURES}, {_NEAR}, w as (select book_id, chapter, case when md like 'Fig%' then 'figure' when md like 'Table%' then 'table' end as what, count(*) as want from cap group by all),
    h as (select book_id, chapter, kind as what, count(*) as had from pairs group by all)
    select p.book_id, p.chapter, 'MEDIUM' as severity, 'FIGURE_NO_CAPTION' as code, mi.page, 1::bigint as n from pairs p join mi using (book_id, chapter, ord) where p.kind = 'figure' and caption_ord is null
    union all select book_id, chapter, 'MEDIUM', 'CAPTION_NO_FIGURE', page, 1 from cap where md like 'Fig%' and not exists (select 1 from pairs p where p.book_id = cap.book_id and p.chapter = cap.chapter and p.caption_ord = cap.ord)
    union all select book_id, chapter, 'HIGH', upper(what) || '_COUNT', null, want - coalesce(had, 0) from w left join h using (book_id, chapter, what) where what is not null and want > coalesce(had, 0)"""
)
def caption_issues(spark: SparkSession, d: str) -> DataFrame:
    """Captions and figures or tables that don't find each other (J10); the item before each figure caption stands for its picture."""
    return S.caption_issues(_with_figures(spark, d))


@query(f"with {ITEMS} select i.book_id, i.chapter, i.ord, b.block_id from items i join (select distinct book_id, page, x0, y0, x1, y1, block_id from blocks where block_type = 'table') b using (book_id, page, x0, y0, x1, y1) where i.kind = 'table'")
def table_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Table items and the table blocks with the same box."""
    return S.equal_boxes(_items(spark, d), table(spark, d, "blocks"))


@query("select md5(raw) as hash, count(*) as n, arg_min(block_id, (book_id, page, ord)) as kept from (select distinct book_id, block_id, page, ord, raw from out_items where raw is not null) group by 1 having count(*) > 1")
def figure_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Contents met more than once; the first stays (W21). The hash of an item's text stands for that of a picture."""
    items = table(spark, d, "out_items").where("raw is not null").select("book_id", "block_id", "page", "ord", "raw").distinct()
    return items.groupBy(F.md5("raw").alias("hash")).agg(F.count("*").alias("n"), F.min_by("block_id", F.struct("book_id", "page", "ord")).alias("kept")).where("n > 1")
