"""References to records that do not exist (problem 6).

Method: the distinct non-null foreign keys are anti-joined with the keys of the parent table, and joined back to the references for the orphans
and their counts per table and period. A key of the parents holds for a time; the few times of each key that is met are joined back with it,
so a reference is an orphan if its key is absent or doesn't hold at the time of the reference. Every join has an equality on the whole key,
so it's hashed or sorted by key whatever the size of a book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.references import chapter_numbers, cited_ranges, explode_range, prose
from foliospark.session import ensure_checkpoint_dir


def resolved(refs: DataFrame, parents: DataFrame, keys: list[str], at: str = "at", since: str = "added_at", until: str = "removed_at") -> DataFrame:
    """The rows of ``refs`` with ``orphan``: no row of ``parents`` holds for their key at the time ``at``: from ``since`` on, before ``until`` (null: still).

    References with a null in their key or time refer to nothing and are left out. Repeated rows of either side count once. ``refs`` is
    materialised, since its keys are asked for before its rows."""
    ensure_checkpoint_dir(refs.sparkSession)
    refs = refs.dropna(subset=[*keys, at]).distinct().checkpoint()
    wanted = refs.select(*keys).distinct()
    known = parents.dropna(subset=[*keys, since]).join(wanted, keys, "left_semi").groupBy(*keys).agg(F.collect_set(F.struct(F.col(since).alias("since"), F.col(until).alias("until"))).alias("__times"))
    absent = wanted.join(known, keys, "left_anti").withColumn("__times", F.lit(None).cast(known.schema["__times"].dataType))
    holds = F.exists("__times", lambda t: (t["since"] <= F.col(at)) & (t["until"].isNull() | (F.col(at) < t["until"])))
    return refs.join(absent.unionByName(known), keys).withColumn("orphan", F.col("__times").isNull() | ~holds).drop("__times")


def orphans(refs: DataFrame, parents: DataFrame, keys: list[str], at: str = "at", since: str = "added_at", until: str = "removed_at") -> DataFrame:
    """The rows of ``refs`` that are orphans, as ``resolved`` has it."""
    return resolved(refs, parents, keys, at, since, until).where("orphan").drop("orphan")


def item_references(out_items: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, at, target_table, target_chapter, target_no): what each item names. ``target_chapter`` is the chapter whose
    reference list is meant, and the number itself for chapters. Items of kind reference are the list and name nothing."""
    items = out_items.where("md is not null and (kind is null or kind <> 'reference')").where(F.col("md").rlike("[0-9]"))
    text = prose(F.col("md"))
    named_chapters = F.transform(chapter_numbers(F.col("text")), lambda x: F.struct(x.alias("lo"), x.alias("hi")))
    named = items.select("book_id", "chapter", "ord", F.col("written_at").alias("at"), text.alias("text")).select(
        "book_id", "chapter", "ord", "at", F.map_from_arrays(F.array(F.lit("chapter_refs"), F.lit("chapters")), F.array(cited_ranges(F.col("text")), named_chapters)).alias("m")
    )
    ranges = named.select("book_id", "chapter", "ord", "at", F.explode("m").alias("target_table", "ranges")).select("book_id", "chapter", "ord", "at", "target_table", F.explode("ranges").alias("r"))
    rows = explode_range(ranges.select("book_id", "chapter", "ord", "at", "target_table", "r.lo", "r.hi"), "lo", "hi", "target_no")
    return rows.withColumn("target_chapter", F.when(F.col("target_table") == "chapters", F.col("target_no")).otherwise(F.col("chapter"))).distinct()


def parent_keys(chapter_refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Both parent tables under one key (target_table, book_id, target_chapter, target_no)."""
    refs = chapter_refs.select(F.lit("chapter_refs").alias("target_table"), "book_id", F.col("chapter").alias("target_chapter"), F.col("ref_no").alias("target_no"), "added_at", "removed_at")
    return refs.union(chapters.select(F.lit("chapters"), "book_id", "number", "number", "added_at", "removed_at"))


_KEYS = ["target_table", "book_id", "target_chapter", "target_no"]


def found(out_items: DataFrame, chapter_refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, target_table, target_no) of the orphan references."""
    lost = orphans(item_references(out_items), parent_keys(chapter_refs, chapters), _KEYS)
    return lost.select("book_id", "chapter", "ord", "target_table", "target_no").distinct()


def report(out_items: DataFrame, chapter_refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(target_table, month, n_refs, n_orphans, orphan_share): references and orphans by target table and month of writing. Tables and
    months without references have no row."""
    rows = resolved(item_references(out_items), parent_keys(chapter_refs, chapters), _KEYS)
    counts = rows.groupBy("target_table", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_refs"), F.count_if("orphan").alias("n_orphans"))
    return counts.withColumn("orphan_share", F.round(F.col("n_orphans") / F.col("n_refs"), 6))
