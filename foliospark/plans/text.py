"""Queries on scalar text functions and page lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import lines as L
from foliospark.plans.registry import joined, query
from foliospark.session import table

_WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _norm(x: str) -> str:
    plain = "replace(" * 7 + x + "".join(f", chr({a}), '{b}')" for a, b in ((64256, "ff"), (64257, "fi"), (64258, "fl"), (64259, "ffi"), (64260, "ffl"), (64261, "st"), (64262, "st")))
    return f"translate({plain}, chr(160) || chr(8201) || chr(8239) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173), '   ')"


def _nws(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[ \t]+', ' ', 'g')")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"select doc_id, {_nws(_norm('text'))} as norm from (select doc_id, regexp_replace(text, '{_WS}*␣', '', 'g') as text from documents)")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Extraction artefacts and blanks made plain."""
    return _docs(spark, d).select("doc_id", T.normalize_ws(T.normalize_chars(T.drop_section_glyph(F.col("text")))).alias("norm"))


_FP = f"left(sha256(lower({_strip(f"regexp_replace(text, '{_WS}+', ' ', 'g')")})), 16)"


@query(f"select doc_id, {_FP} as fingerprint, left(sha256(text), 12) as raw_hash from documents where text is not null")
def text_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint that blanks and case don't change, and the hash of the raw text."""
    text = F.col("text")
    return _docs(spark, d).where("text is not null").select("doc_id", T.fingerprint(text).alias("fingerprint"), F.left(F.sha2(text, 256), F.lit(12)).alias("raw_hash"))


@query(f"select fp as fingerprint, min(doc_id) as first_doc, count(*) as n from (select doc_id, {_FP} as fp from documents where text is not null) group by fp having count(*) > 1")
def duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents share."""
    return text_fingerprint(spark, d).groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


_SLUG = "lower(trim(regexp_replace(regexp_replace(title, '[^\\x{0}-\\x{7F}]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '-'))"
_ANCHOR = _strip("regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\- ]', '', 'g')")


@query(f"select book_id, coalesce(nullif(trim(left({_SLUG}, 60), '-'), ''), 'untitled') as slug, replace({_ANCHOR}, ' ', '-') as anchor from books where title is not null")
def slugify_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Slugs and heading anchors of titles."""
    t = F.col("title")
    return table(spark, d, "books").where("title is not null").select("book_id", T.slug(t).alias("slug"), T.anchor(t).alias("anchor"))


#: Compatibility forms that the SQL side takes apart: full width by one rule, ligatures one by one; accents by its own function.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_PLAIN_TITLE = f"translate(replace(replace(replace(replace(replace(title, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '{_WIDE}', '{_NARROW}')"
_PLAIN_TITLE = rf"regexp_replace({_PLAIN_TITLE}, '[\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"
_SLUG_OF = _SLUG.replace("title", "t")


@query(f"select distinct book_id, number, coalesce(nullif(trim(left({_SLUG_OF}, 60), '-'), ''), 'untitled') as slug from (select book_id, number, strip_accents({_PLAIN_TITLE}) as t from chapters where title is not null)")
def slugify_nfkd(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of titles after compatibility decomposition."""
    return table(spark, d, "chapters").where("title is not null").select("book_id", "number", T.slug(T.decompose("title")).alias("slug")).distinct()


_BAD = r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F8FF}\x{FFFD}]"


@query(
    f"""select book_id, page, count(*) as lines, count(*) filter (where junk >= 0.25) as junk_lines from (
    select distinct book_id, page, block_seq, line_no, text, length(regexp_replace(s, '[^' || '{_BAD[1:-1]}' || ']', '', 'g')) / nullif(length(s), 0) as junk
    from (select *, regexp_replace(text, '{_WS}', '', 'g') as s from page_lines where text is not null)) group by all"""
)
def junk_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Unreadable lines of each page (P5)."""
    lines = L.unique_lines(table(spark, d, "page_lines")).select("book_id", "page", T.junk_share(F.col("text")).alias("junk"))
    return lines.groupBy("book_id", "page").agg(F.count("*").alias("lines"), F.count_if(F.col("junk") >= 0.25).alias("junk_lines"))


@query(r"select distinct book_id, page, block_seq, line_no, text from page_lines where regexp_matches(text, '(?i)^[ \t\n]*(?:page[ \t\n]*)?[0-9]{1,5}[ \t\n]*$')")
def page_number_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are a page number."""
    lines = L.unique_lines(table(spark, d, "page_lines"))
    return lines.where(T.is_page_number(F.col("text"))).select("book_id", "page", "block_seq", "line_no", "text")


_LINES = "l as (select distinct book_id, page, block_seq, line_no, text, x0, y0, x1, y1, size, bold, italic from page_lines where text is not null)"
_MARGIN = f"lower(regexp_replace({_nws(_norm('text'))}, '[0-9]+', '#', 'g'))"


@query(
    f"""with {_LINES}, n as (select book_id, count(distinct page) as n from l group by 1),
    k as (select book_id, {_MARGIN} as margin, count(distinct page) as pages from l where (y0 + y1) / 2 < 64.0 or (y0 + y1) / 2 > 736.0 group by 1, 2)
    select book_id, margin, pages from k join n using (book_id) where margin <> '' and pages >= greatest(2, floor(0.4 * n))"""
)
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated in the margins of a book's pages."""
    return L.running_margin_lines(L.unique_lines(table(spark, d, "page_lines")))


_VOCAB = (
    f"with {_LINES}, b as (select book_id, text, lag(text) over (partition by book_id order by page, block_seq, line_no) as prev from l), "
    r"v as (select book_id, regexp_replace(case when regexp_matches(coalesce(prev, ''), '[A-Za-z]-[\t-\r ]*$') then regexp_replace(text, '^[\t-\r ]*[A-Za-z]+', '') else text end, '[A-Za-z]+-[\t-\r ]*$', '') as t from b) "
)


@query(_VOCAB + "select distinct book_id, lower(w) as word from (select book_id, unnest(regexp_extract_all(t, '[A-Za-z]{2,}')) as w from v)")
def vocab_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of each book (A5)."""
    return L.words(L.unique_lines(table(spark, d, "page_lines")))


@query(_VOCAB + r"select distinct book_id, lower(w) as compound from (select book_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_\-]+')) as w from v) where regexp_matches(w, '^[A-Za-z]{2,}-[A-Za-z]{2,}$')")
def vocab_compounds(spark: SparkSession, d: str) -> DataFrame:
    """Hyphenated words of each book (A5)."""
    return L.compounds(L.unique_lines(table(spark, d, "page_lines")))


_HERE = "regexp_matches(t[i - 1:i - 1], '[A-Za-z0-9]') and "
_LOOSE = f"len(list_filter(range(2, length(t)), lambda i: {_HERE} t[i:i + 1] = '- ' and regexp_matches(t[i + 2:i + 2], '[A-Za-z0-9]')))"
_TIGHT = f"len(list_filter(range(2, length(t)), lambda i: {_HERE} t[i:i] = '-' and regexp_matches(t[i + 1:i + 1], '[A-Za-z0-9]')))"
_TALLIES = f"select book_id, sum(case when contains(t, '-') then {_LOOSE} else 0 end)::bigint as loose, sum(case when contains(t, '-') then {_TIGHT} else 0 end)::bigint as tight from v group by 1"


@query(_VOCAB + _TALLIES)
def vocab_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Hyphens with and without a blank in each book (A5). The SQL looks at each place, since RE2 has no look-ahead."""
    return L.hyphen_tallies(L.unique_lines(table(spark, d, "page_lines")))


_ENTRIES = r"""wd as (select distinct book_id, lower(w) as e from (select book_id, unnest(regexp_extract_all(t, '[A-Za-z]{2,}')) as w from v)),
cp as (select distinct book_id, lower(w) as e from (select book_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_\-]+')) as w from v) where regexp_matches(w, '^[A-Za-z]{2,}-[A-Za-z]{2,}$')), en as (select * from wd union select * from cp)"""
_PREFIXES = "anti b bi c co cross d e ex full g grade half high inter intra long low mid mono multi near non over poly post pre re self semi short stage t tri type under well x".split()
#: Literal cases beside the tables: a book of its own, whose words are those of its lines.
_CASES = [
    ("1-1", ["the pedi-", "atric patient"]), ("1-2", ["a long-", "term plan"]), ("1-3", ["Smith-", "Jones syndrome"]), ("1-4", ["anti-", "body titres"]), ("1-5", ["in the pedi-", "atric-", "ward now"]), ("1-6", ["some ab-", "cd text"]),
    ("2-1", ["The pediatric ward and antibody levels", "a long-term plan of the patient"]),
]
_CASE_LINES = ", ".join(f"('cases', {int(b.partition('-')[0])}, {int(b.partition('-')[2])}, {i}, '{t}')" for b, lines in _CASES for i, t in enumerate(lines, 1))
_WITH_CASES = _VOCAB.replace("with l as (", "with recursive l as (").replace("where text is not null)", f"where text is not null union all select *, 0.0, 0.0, 0.0, 0.0, 0.0, false, false from (values {_CASE_LINES}))", 1).rstrip()


def _with_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = [("cases", *(int(x) for x in b.split("-")), i, t) for b, lines in _CASES for i, t in enumerate(lines, 1)]
    cases = spark.createDataFrame(rows, "book_id STRING, page INT, block_seq INT, line_no INT, text STRING")
    cases = cases.select("*", *(F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1", "size")), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    return table(spark, d, "page_lines").select(*cases.columns).union(cases)


@query(
    f"""{_WITH_CASES}, {_ENTRIES}, bl as (select *, row_number() over (partition by book_id, page, block_seq order by line_no) as i from (select book_id, page, block_seq, line_no, {_nws('text')} as t from l) where t <> ''),
    no as (select book_id, page, block_seq, max(i) as n from bl group by all), every as (select distinct book_id, page, block_seq from l),
    fold as (select book_id, page, block_seq, i, t as text, '' as unsure from bl where i = 1
      union all select book_id, page, block_seq, i, case when tail = '' or head = '' then text || ' ' || t when joins then left(text, length(text) - 1) || t else text || t end,
        case when tail <> '' and head <> '' and not joins and lower_first and not compound and not two then unsure || case when unsure = '' then '' else '|' end || tail || '-' || head else unsure end
      from (select *, lower_first and (whole or (not compound and not two and not lw and length(tail) >= 3)) as joins from (
        select f.book_id, f.page, f.block_seq, b.i, f.text, f.unsure, b.t, f.tail, b.head, regexp_matches(b.head, '^[a-z]') as lower_first, w.e is not null as whole, l1.e is not null as lw,
          c.e is not null or lower(f.tail) in ({', '.join(f"'{x}'" for x in _PREFIXES)}) as compound, l1.e is not null and r1.e is not null and length(f.tail) > 3 and length(b.head) > 3 as two
        from (select *, regexp_extract(text, '([A-Za-z]+)-$', 1) as tail from fold) f join (select *, regexp_extract(t, '^([A-Za-z]+)', 1) as head from bl) b on b.book_id = f.book_id and b.page = f.page and b.block_seq = f.block_seq and b.i = f.i + 1
        left join en w on w.book_id = f.book_id and w.e = lower(f.tail || b.head) left join en l1 on l1.book_id = f.book_id and l1.e = lower(f.tail) left join en r1 on r1.book_id = f.book_id and r1.e = lower(b.head) left join en c on c.book_id = f.book_id and c.e = lower(f.tail || '-' || b.head))))
    select book_id, page || '-' || block_seq as block, coalesce(text, '') as text, coalesce(unsure, '') as unsure from every left join (select f.* from fold f join no on no.book_id = f.book_id and no.page = f.page and no.block_seq = f.block_seq and no.n = f.i) using (book_id, page, block_seq)"""
)
def dehyphenate_join(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as paragraphs, words divided at line ends joined by the book's vocabulary (W9, J11); with some literal cases."""
    pages = _with_cases(spark, d)
    lines = L.unique_lines(pages)
    return joined(L.join_blocks(L.block_lines(pages), L.words(lines), L.compounds(lines)), "unsure")


_FAULTS = ["Te cat. Tere is A%er care", "a fi ction of efﬁ cient waﬂ e", "The patient ␣ of ward"]
_FAULT_ROWS = ", ".join(f"('cases', 'f{i}', '{t}')" for i, t in enumerate(_FAULTS))
_FAULT_WORDS = "after fiction care cases is of the cat"
_LOST = dict(zip("Te Tey Tem Tis Tat Tese Tose Tere Tus Terefore Terapy Terapeutic Tird Trombocytopenia Tyroid".split(), "The They Them This That These Those There Thus Therefore Therapy Therapeutic Third Thrombocytopenia Thyroid".split()))


def _th() -> str:
    out = "text"
    for seen, meant in _LOST.items():
        out = f"regexp_replace({out}, '\\b{seen}\\b', '{meant}', 'g')"
    return out


@query(
    rf"""{_VOCAB.replace('with l as (', 'with recursive l as (').rstrip()}, wd as (select distinct book_id, lower(w) as e from (select book_id, unnest(regexp_extract_all(t, '[A-Za-z]{{2,}}')) as w from v) union select 'cases', unnest(string_split('{_FAULT_WORDS}', ' '))),
    ta as ({_TALLIES}), tx as (select distinct book_id, block_id as block, raw_text as text from blocks where raw_text is not null union all select * from (values {_FAULT_ROWS})),
    th as (select book_id, block, {_th()} as text, list_transform(regexp_extract_all(text, '\bT(?:{'|'.join(w[1:] for w in _LOST)})\b'), lambda w: w || '>' || replace(w, 'T', 'Th')) as lost from tx),
    ask as (select distinct book_id, block, seen, meant, ws, case when kind = 'ft' then [lower(meant)] else [lower(meant)] end as yes, case when kind = 'ft' then [] else [lower(a), b] end as nos from (
      select book_id, block, 'ft' as kind, w as seen, replace(w, '%', 'ft') as meant, '' as a, '' as b, 0 as ws from (select book_id, block, unnest(regexp_extract_all(text, '\b[A-Za-z]+%[a-z][A-Za-z%]*\b')) as w from th)
      union all select book_id, block, 'fi', a || ' ' || b, a || b, a, b, 1 from (select book_id, block, unnest(regexp_extract_all(text, '\b([A-Za-z]*(?:ffi|ffl|ff|fi|fl))[\t-\r ]([a-z]{{2,}})\b', 1)) as a, unnest(regexp_extract_all(text, '\b([A-Za-z]*(?:ffi|ffl|ff|fi|fl))[\t-\r ]([a-z]{{2,}})\b', 2)) as b from th))),
    ok as (select a.* from ask a where exists (select 1 from wd where wd.book_id = a.book_id and list_contains(a.yes, wd.e)) or (len(a.nos) > 0 and not exists (select 1 from wd where wd.book_id = a.book_id and list_contains(a.nos, wd.e)))),
    fx as (select book_id, block, list(seen || '>' || meant order by seen, meant) as fixes, list({{s: seen, m: meant}} order by seen, meant) as fs from ok group by all),
    fold as (select th.book_id, th.block, 0 as i, th.text, th.lost, coalesce(fixes, []) as fixes, fs from th left join fx using (book_id, block)
      union all select book_id, block, i + 1, replace(text, fs[i + 1].s, fs[i + 1].m), lost, fixes, fs from fold where i < len(fixes)),
    fixed as (select f.*, coalesce(loose >= 5 and loose >= 3 * tight, false) as many from fold f left join ta using (book_id) where i = len(fixes))
    select book_id, block, regexp_replace(text, '{_WS}*␣', '', 'g') as text, array_to_string(list_concat(lost, fixes), '|') as repairs from fixed"""
)
def repair_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Faults of font encodings repaired by the book's words (P7-P11); with some literal cases. The SQL leaves hyphens before a blank alone, since no book has
    three times as many of them as of others."""
    lines = L.unique_lines(table(spark, d, "page_lines"))
    texts = table(spark, d, "blocks").where("raw_text is not null").select("book_id", F.col("block_id").alias("block"), F.col("raw_text").alias("text")).distinct()
    texts = texts.union(spark.createDataFrame([("cases", f"f{i}", t) for i, t in enumerate(_FAULTS)], texts.schema))
    words = L.words(lines).union(spark.createDataFrame([("cases", w) for w in _FAULT_WORDS.split()], "book_id STRING, word STRING"))
    rows = L.repair_faults(texts, words, L.hyphen_tallies(lines))
    return joined(rows.withColumn("repairs", F.transform("repairs", lambda x: F.concat_ws(">", x["seen"], x["meant"]))), "repairs")


@query(
    rf"""{_VOCAB.rstrip()}, lost as (select book_id, w as seen, replace(w, 'T', 'Th') as meant from (select book_id, unnest(regexp_extract_all(text, '\bT(?:{'|'.join(w[1:] for w in _LOST)})\b')) as w from (select distinct book_id, block_id, raw_text as text from blocks where raw_text is not null union all select * from (values {_FAULT_ROWS})))),
    n as (select book_id, seen, meant, count(*) as n from lost group by all), k as (select *, row_number() over (partition by book_id order by n desc, seen, meant) as k from n)
    select book_id, seen, meant, n from k where k <= 8 and seen like 'T%'"""
)
def top_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent repairs of each book (A10, T3): of lost letters, which SQL can count by itself."""
    texts = table(spark, d, "blocks").where("raw_text is not null").select("book_id", F.col("block_id").alias("block"), F.col("raw_text").alias("text")).distinct()
    texts = texts.union(spark.createDataFrame([("cases", f"f{i}", t) for i, t in enumerate(_FAULTS)], texts.schema))
    lines = L.unique_lines(table(spark, d, "page_lines"))
    return L.top_repairs(L.repair_faults(texts, L.words(lines), L.hyphen_tallies(lines))).where("seen like 'T%'")


@query(
    r"""select book_id, block_id, regexp_replace('<!-- source_page: ' || page || ' -->' || chr(10) || md, '<!--[\t-\r ]*source_page:[\t-\r ]*([0-9]+)[\t-\r ]*-->', '> **[Trang gốc: \1]**', 'g') as source_view,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?m)^> \*\*KEY (POINTS?)\*\*', '> [!key] KEY \1', 'g'), '(?m)^> \*\*CLINICAL (PEARLS?)\*\*', '> [!clinical] CLINICAL \1', 'g'),
      '(?m)^> \*\*IMPORTANT\*\*', '> [!important] IMPORTANT', 'g'), '(?m)^> \*\*SUMMARY\*\*', '> [!summary] SUMMARY', 'g'), '(?m)^> \*\*CONTROVERSIES\*\*', '> [!controversies] CONTROVERSIES', 'g'), '(?m)^> \*\*WARNING\*\*', '> [!warning] WARNING', 'g'), '(?m)^> \*\*NOTE\*\*', '> [!note] NOTE', 'g') as note_view
    from (select distinct book_id, block_id, page, md from out_items)"""
)
def view_modes(spark: SparkSession, d: str) -> DataFrame:
    """Items as the source view and the note view show them."""
    items = table(spark, d, "out_items").select("book_id", "block_id", "page", "md").distinct()
    marked = F.concat(F.format_string("<!-- source_page: %d -->\n", "page"), "md")
    return items.select("book_id", "block_id", T.view_mode(marked, "source").alias("source_view"), T.view_mode(F.col("md"), "obsidian").alias("note_view"))


@query(
    f"""select book_id, block_id, {_strip("regexp_replace(regexp_replace(md, '(?s)<!--.*?-->', '', 'g'), '<a id=\"[^\"]*\"></a>', '', 'g')")} as clean,
    regexp_replace(md, '<[^>]+>|\\|', ' ', 'g') as words, '"' || replace(replace(md, '\\', '\\\\'), '"', '\\"') || '"' as quoted from (select distinct book_id, block_id, md from out_items)"""
)
def retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    """Markdown as retrieval, table search and front matter take it."""
    items = table(spark, d, "out_items").select("book_id", "block_id", "md").distinct()
    md = F.col("md")
    return items.select("book_id", "block_id", T.for_retrieval(md).alias("clean"), T.table_words(md).alias("words"), T.yaml_quoted(md).alias("quoted"))
