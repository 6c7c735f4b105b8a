"""Queries on search, retrieval chunks and term indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import retrieval as V
from foliospark.operators import structure as S
from foliospark.operators.search import Index, searchable
from foliospark.plans.registry import joined, query
from foliospark.plans.quality import CURRENT
from foliospark.plans.structure import ITEMS, PATHS
from foliospark.session import ensure_checkpoint_dir, table
from foliospark.sources.layout import read_chunks, write_chunks

_WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_KEY = "book_id, chapter, ord"


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<a id=\"[^\"]*\"></a>', '', 'g'), '^{_WS}+', ''), '{_WS}+$', '')"


_DOCS = f"""{ITEMS}, docs as (select *, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') as t from (select book_id, chapter, ord, kind, {_clean("case when kind = 'table' then regexp_replace(md, '<[^>]+>|\\|', ' ', 'g') else md end")} as text from items where md is not null) where text <> ''),
st as (select count(*) as n, avg(len(t)) as average from docs)"""


def _bm25(phrases: list[list[str]], where: str = "true", docs: str = "", key: str = _KEY) -> str:
    """The SQL of a search; a word may be given in its forms, parted by bars."""

    def tf(p: list[str]) -> str:
        here = " and ".join(f"t[i + {k}] in ({', '.join(f"'{x}'" for x in w.split('|'))})" for k, w in enumerate(p))
        return f"len(list_filter(range(1, len(t) - {len(p)} + 2), lambda i: {here}))"

    tfs = ", ".join(f"{tf(p)} as tf{i}" for i, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(phrases)))
    score = " + ".join(f"case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(t) / average))" for i in range(len(phrases)))
    both = " and ".join(f"tf{i} > 0" for i in range(len(phrases)))
    return f"{docs or 'with ' + _DOCS}, tf as (select *, {tfs} from docs), df as (select {dfs} from tf) select {key}, round(-({score}), 9) as score from tf, df, st where {both} and {where}"


def _index(spark: SparkSession, d: str, stemmed: bool = False) -> Index:
    return Index(searchable(S.ordered_items(table(spark, d, "out_items"))), ["book_id", "chapter", "ord"], "text", stemmed)


@query(f"with {_DOCS}, x as (select {_KEY}, unnest(t) as term from docs), p as (select term, {_KEY}, count(*) as tf from x group by all) select term, count(*) as docs, sum(tf)::bigint as occurrences, max(tf) as most from p group by term")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the index (F1)."""
    return _index(spark, d).postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@query(_bm25([["risk"], ["doubles"], ["fatigue"]]) + f" order by score, {_KEY} limit 30")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 30 best items for three words."""
    return _index(spark, d).top("risk doubles fatigue")


@query(_bm25([["by", "contrast"]]))
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Items with a phrase."""
    return _index(spark, d).match('"by contrast"')


@query(_bm25([["long", "term"], ["residents"]], "kind = 'list' and chapter <= 5"))
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Items of a kind and of some chapters with a hyphenated word."""
    return _index(spark, d).match("long-term residents", (F.col("kind") == "list") & (F.col("chapter") <= 5))


@query(_bm25([["complain|complains|complained|complaining"], ["patient|patients|patiently"]]) + f" order by score, {_KEY} limit 30")
def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    """The best items for words in any form (F2)."""
    return _index(spark, d, stemmed=True).top("complaining patients")


@query(
    f"""with top as ({_bm25([["bilateral"], ["membrane"]])} order by score, {_KEY} limit 30), {_DOCS},
    h as (select {_KEY}, score, t, list_transform(t, lambda x: case when x in ('bilateral', 'membrane') then '[[' || x || ']]' else x end) as w, list_min(list_filter([list_position(t, 'bilateral'), list_position(t, 'membrane')], lambda x: x > 0)) - 1 as hit from docs join top using ({_KEY})),
    s as (select *, greatest(0, least(hit - 6, len(t) - 24)) as b from h)
    select {_KEY}, score, case when b > 0 then '… ' else '' end || array_to_string(w[b + 1:b + 24], ' ') || case when b + 24 < len(t) then ' …' else '' end as snippet from s"""
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    """The best items and where they hold the words."""
    return _index(spark, d).snippets("bilateral membrane", k=30)


_SECTIONS = f"""{PATHS}, srows as (select *, (kind = 'heading' or coalesce(section_id is distinct from lag(section_id) over w, true) or lag(ord) over w is null)::int as begins from items join paths using (book_id, chapter, ord) where md is not null and kind not in ('chapter_title', 'footnote') window w as (partition by book_id, chapter order by ord)),
sections as (select *, sum(begins) over (partition by book_id, chapter order by ord)::bigint as section from srows)"""


@query(f"with {_SECTIONS} select book_id, chapter, section, count(*) as n, min(ord) as first_ord, min(page) as first_page, max(page) as last_page, array_to_string(arg_min(path, ord), '|') as path from sections group by all")
def rag_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections for retrieval."""
    rows = V.sections(S.ordered_items(table(spark, d, "out_items")))
    rows = rows.groupBy("book_id", "chapter", "section").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("path", "ord").alias("path"))
    return joined(rows, "path")


_CHUNKS = f"""{_SECTIONS}, body as (select *, length(t) as n, row_number() over (partition by book_id, chapter, section order by ord) as i from (select *, {_clean('md')} as t from sections where kind <> 'heading') where t <> ''),
fold as (select book_id, chapter, section, ord, i, n as size, 1 as chunk from body where i = 1
  union all select b.book_id, b.chapter, b.section, b.ord, b.i, case when f.size + b.n > 1800 then b.n else f.size + b.n end, case when f.size + b.n > 1800 then f.chunk + 1 else f.chunk end
  from fold f join body b on b.book_id = f.book_id and b.chapter = f.chapter and b.section = f.section and b.i = f.i + 1)"""


@query(
    f"""with recursive {_CHUNKS} select book_id, chapter, section, chunk, string_agg(ord::varchar, '|' order by ord) as ords, sum(b.n)::bigint as n_chars, array_to_string(list_transform(list_sort(list(distinct page)), lambda x: x::varchar), '|') as pages,
    case when bool_and(kind = 'reference') then 'reference' when bool_and(kind = 'table') then 'table' else 'text' end as content_type, md5(string_agg(t, chr(10) || chr(10) order by ord)) as body_hash
    from fold f join body b using (book_id, chapter, section, ord) group by all"""
)
def rag_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of sections for retrieval."""
    c = V.chunks(S.ordered_items(table(spark, d, "out_items")))
    body = F.when(F.size("path") > 0, F.substr("text", F.length(F.array_join("path", " > ")) + 3)).otherwise(F.col("text"))
    c = c.select("book_id", "chapter", "section", "chunk", "ords", "n_chars", "pages", "content_type", F.md5(body).alias("body_hash"))
    return joined(joined(c, "ords"), "pages")


_CHUNK_KEY = "book_id, chapter, section, chunk"
_CHUNK_DOCS = f"""with recursive {_CHUNKS}, ct as (select book_id, chapter, section, chunk, string_agg(t, chr(10) || chr(10) order by ord) as body from fold f join body b using (book_id, chapter, section, ord) group by all),
sp as (select book_id, chapter, section, arg_min(path, ord) as path from body group by all),
docs as (select *, regexp_extract_all(strip_accents(lower(case when len(path) > 0 then array_to_string(path, ' > ') || chr(10) || chr(10) else '' end || body)), '[\\p{{L}}\\p{{N}}]+') as t from ct join sp using (book_id, chapter, section)),
st as (select count(*) as n, avg(len(t)) as average from docs)"""


@query(_bm25([["grip"], ["strength"]], docs=_CHUNK_DOCS, key=_CHUNK_KEY) + f" order by score, {_CHUNK_KEY} limit 30")
def fts_reindex(spark: SparkSession, d: str) -> DataFrame:
    """The chunks written as files, the index rebuilt from these, and a search in it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/chunks-{uuid.uuid4().hex}"
    write_chunks(V.chunks(S.ordered_items(table(spark, d, "out_items"))), folder)
    return Index(read_chunks(spark, folder).drop("path"), ["book_id", "chapter", "section", "chunk"], "text").top("grip strength")


# The patterns of the terms once more, for the SQL side alone.
_SICK = r"\b([A-Z]?[a-z]+(?:algia|uria|penia|plasia|oma|pathy|aemia|emia|osis|itis)|[A-Z][a-z]+ (?:fever|anemia|deficiency|disorder|disease|syndrome))\b"
_CURE = r"(?i)\b([a-z]+(?:solone|sone|parin|caine|zepam|barbital|setron|prazole|thiazide|floxacin|mab|dipine|olol|sartan|pril|statin|vir|azole|cycline|cillin|mycin))\b"
_SIGNS = "abdominal pain,apnea,bleeding,bruising,cough,cyanosis,dehydration,diarrhea,dyspnea,edema,failure to thrive,fatigue,fever,headache,hematuria,hepatomegaly,hypotension,irritability,jaundice,lethargy,pallor,rash,seizure,splenomegaly,stridor,tachycardia,tachypnea,vomiting,weight loss,wheezing".split(",")
_CASE_ITEMS = [
    (1, "heading", "## Joints <!-- section_id: pneumonitis -->", "c-1"), (2, "paragraph", "hepatitis nephritis arthritis and Wilson disease; Syndrome Disease, pyuria", "c-1"),
    (3, "paragraph", "Amoxicillin amoxicillin vir statin, Hodgkin fever with high fever", "c-1"), (4, "paragraph", "No heading fallback: osteoma_x xosteoma cardiopathy", "c-1"),
]
_CASE_SQL = " union all ".join(f"select 'cases', 0, {o}, '{k}', '{md}', 1, 0.0, 0.0, 0.0, 0.0, 'x', null, null, 1.0, case when '{k}' = 'heading' then 2 end, '{sid}'" for o, k, md, sid in _CASE_ITEMS)
_CASE_PATHS = PATHS.replace("from out_items)", f"from out_items union all {_CASE_SQL} union all select 'cases', 7, 1, 'paragraph', 'A nephrosis without heading', 1, 0.0, 0.0, 0.0, 0.0, 'x', null, null, 1.0, null, 'c-7')", 1)
_TERMS = f"""{_CASE_PATHS}, {CURRENT.replace("from chapters where number is not null", "from (select book_id, number, title, start_page, end_page, confidence, source, added_at from chapters union all select 'cases', 7, 'Kidneys', 1, 1, 1.0, 'manual', timestamp '2020-01-01') where number is not null")},
txt as (select i.book_id, i.chapter, coalesce(c.title, '') as chapter_title, coalesce(i.section_id, '') as section_id, coalesce(path[-1], c.title, '') as heading, case when i.kind = 'heading' then regexp_extract(md, '^#{{1,6}} ([^\\n]*)', 1) end as own, {_clean('md')} as text
  from items i join paths using (book_id, chapter, ord) left join cur c on c.book_id = i.book_id and c.chapter = i.chapter where md is not null),
terms as (select distinct * from (
  select book_id, 'diseases' as category, w as term, chapter, chapter_title, section_id, heading from (select *, unnest(regexp_extract_all(text, '{_SICK}', 1)) as w from txt) where length(w) > 5 and w not in ('Syndrome', 'Disease', 'Disorder')
  union all select book_id, 'drugs', lower(unnest(regexp_extract_all(text, '{_CURE}', 1))), chapter, chapter_title, section_id, heading from txt
  union all select book_id, 'topics', own, chapter, chapter_title, section_id, heading from txt where own <> ''
  union all select book_id, 'signs_symptoms', s, chapter, chapter_title, section_id, heading from txt, (select unnest([{', '.join(f"'{s}'" for s in _SIGNS)}]) as s) where contains(lower(text), s)))"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of all items, with some literal ones."""
    items, chapters = S.ordered_items(table(spark, d, "out_items")), table(spark, d, "chapters")
    rows = [("cases", 0, o, k, md, 2 if k == "heading" else None, sid) for o, k, md, sid in _CASE_ITEMS] + [("cases", 7, 1, "paragraph", "A nephrosis without heading", None, "c-7")]
    cases = spark.createDataFrame(rows, "book_id STRING, chapter INT, ord INT, kind STRING, md STRING, level INT, section_id STRING")
    title = spark.createDataFrame([("cases", 7, "Kidneys")], "book_id STRING, number INT, title STRING").withColumn("added_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    return V.index_terms(V.index_places(items.unionByName(cases, allowMissingColumns=True), chapters.unionByName(title, allowMissingColumns=True)))


@query(f"with {_TERMS} select book_id, category, term, count(*) as n, count(distinct chapter) as chapters from terms group by all")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the navigation indexes and in how many sections and chapters they stand (F8, A17); with some literal items."""
    return _terms(spark, d).groupBy("book_id", "category", "term").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"))


_ANCHOR = f"replace(regexp_replace(regexp_replace(regexp_replace(lower(heading), '[^\\p{{L}}\\p{{N}}_\\- ]', '', 'g'), '^{_WS}+', ''), '{_WS}+$', ''), ' ', '-')"
_INDEX_LINES = f"""k as (select *, row_number() over (partition by book_id, category, term order by chapter, chapter_title, section_id, heading) as k from terms),
il as (select book_id, category, term, count(*) as n, '- **' || term || '** — ' || string_agg('[Ch ' || chapter || ': ' || heading || '](chapters/ch_' || lpad(chapter::varchar, 3, '0') || '.md#' || {_ANCHOR} || ')', '; ' order by k) filter (where k <= 8) || case when count(*) > 8 then ' …' else '' end as line from k group by book_id, category, term),
lines as (select book_id, category, term, row_number() over (partition by book_id, category order by lower(term), term) as place, n, line from il)"""


@query(f"with {_TERMS}, {_INDEX_LINES} select * from lines")
def index_top_locations(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the navigation indexes in their order."""
    return V.index_lines(_terms(spark, d))


@query(
    f"""with {_TERMS}, {_INDEX_LINES} select book_id, category, md5('# ' || case category when 'diseases' then 'Diseases' when 'drugs' then 'Drugs' when 'topics' then 'Topics' else 'Signs & Symptoms' end || ' Index' || chr(10) || chr(10)
      || '> **Generated navigation index — not part of the original textbook.**' || chr(10) || '> Entries link to the chapter and section where the term appears. No factual text is added.' || chr(10) || chr(10)
      || '_Method: deterministic pattern matching. Verify in the chapter text._' || chr(10) || chr(10) || string_agg(line, chr(10) order by place) || chr(10)) as page_hash from lines group by book_id, category"""
)
def index_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the navigation indexes (K8); compared by their hash."""
    return V.index_pages(V.index_lines(_terms(spark, d))).select("book_id", "category", F.md5("page").alias("page_hash"))
