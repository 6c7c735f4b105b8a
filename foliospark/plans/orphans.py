"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans.registry import query
from foliospark.session import table

_P6_REFS = r"""
with items as (select distinct book_id, chapter, ord, written_at as ts,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?s)```.*?(?:```|$)', ' ', 'g'), '`[^`\n]*`', ' ', 'g'),
        '(?s)\$\$.*?\$\$', ' ', 'g'), '\$[^$\n]+\$', ' ', 'g'), '\]\([^()\n]*\)', ']', 'g') as t
  from out_items where md is not null and (kind is null or kind <> 'reference')),
cites as (select book_id, chapter, ord, ts, unnest(string_split_regex(regexp_replace(g, '[ \x{A0}]', '', 'g'), '[,;]')) as p from
    (select book_id, chapter, ord, ts, unnest(regexp_extract_all(t, '\[([0-9]{1,9}(?:[ \x{A0}]*[,;\-‐‑–—−][ \x{A0}]*[0-9]{1,9})*)\]', 1)) as g from items)),
nums as (select book_id, chapter, ord, ts, 'chapter_refs' as target_table, chapter as target_chapter,
    unnest(case when regexp_matches(p, '^[0-9]+$') then [p::int] else
      range(regexp_extract(p, '^([0-9]+)[-‐‑–—−]([0-9]+)$', 1)::int, regexp_extract(p, '^([0-9]+)[-‐‑–—−]([0-9]+)$', 2)::int + 1) end) as target_no from cites),
chaps as (select book_id, chapter, ord, ts, 'chapters' as target_table,
    unnest(regexp_extract_all(t, '(?:^|[^A-Za-z])(?:Chapters?|Chap\.)[ \x{A0}\x{2007}\x{2009}\x{202F}]*([0-9]{1,9})', 1)
      || regexp_extract_all(t, '(?:^|[^A-Za-z])(?:Tables?|Figures?|Figs?\.)[ \x{A0}\x{2007}\x{2009}\x{202F}]*([0-9]{1,9})\.[0-9]', 1))::int as target_no from items),
refs as (select distinct book_id, chapter, ord, ts, target_table, target_chapter, target_no::int as target_no from nums
  union select distinct book_id, chapter, ord, ts, target_table, target_no, target_no from chaps),
named as (select * from refs where book_id is not null and target_chapter is not null and target_no is not null and ts is not null),
lost as (select * from named r where not exists (select 1 from chapter_refs c where r.target_table = 'chapter_refs' and c.book_id = r.book_id
      and c.chapter = r.target_chapter and c.ref_no = r.target_no and c.added_at <= r.ts and (c.removed_at is null or r.ts < c.removed_at))
    and not exists (select 1 from chapters c where r.target_table = 'chapters' and c.book_id = r.book_id and c.number = r.target_no
      and c.added_at <= r.ts and (c.removed_at is null or r.ts < c.removed_at)))
"""


@query(_P6_REFS + "select distinct book_id, chapter, ord, target_table, target_no from lost")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References to reference-list entries and chapters that don't hold at the time of writing."""
    from foliospark.operators.orphans import found

    return found(table(spark, d, "out_items"), table(spark, d, "chapter_refs"), table(spark, d, "chapters"))


@query(
    _P6_REFS
    + """, total as (select target_table, strftime(ts, '%Y-%m') as month, count(*) as n_refs from named group by 1, 2),
bad as (select target_table, strftime(ts, '%Y-%m') as month, count(*) as n_orphans from lost group by 1, 2)
select target_table, month, n_refs, coalesce(n_orphans, 0) as n_orphans, round(coalesce(n_orphans, 0) / n_refs, 6) as orphan_share
from total left join bad using (target_table, month)"""
)
def p6_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per target table and month."""
    from foliospark.operators.orphans import report

    return report(table(spark, d, "out_items"), table(spark, d, "chapter_refs"), table(spark, d, "chapters"))
