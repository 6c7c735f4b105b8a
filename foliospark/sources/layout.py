"""Sources and sinks: layout files as tables, chapters and chunks as files."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType()), *(T.StructField(n, T.BooleanType()) for n in ("bold", "italic", "sup", "sub"))])
LINES = T.StructType(
    [T.StructField("book_id", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("page", "block_seq", "line_no")), T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1", "size")),
     T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType()), T.StructField("spans", T.ArrayType(SPAN))]
)
CHUNKS = "book_id STRING, chapter INT, section LONG, chunk INT, section_id STRING, path ARRAY<STRING>, pages ARRAY<INT>, refs ARRAY<INT>, content_type STRING, text STRING"


class LayoutReader(DataSourceReader):
    """Reads layout files, one JSON document a page: {book_id, page, blocks: [{lines: [{bbox, spans}]}]}. A file that can't be read gives one line
    without text, so that a bad page is seen and doesn't stop the others."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.per_task = options["path"], int(options.get("filesPerTask", "256"))

    def partitions(self) -> list[InputPartition]:
        files = [os.path.join(self.folder, f) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")]
        return [InputPartition(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in partition.value:
            yield from self._page(file)

    def _page(self, file: str) -> Iterator[tuple]:
        try:
            with open(file, encoding="utf-8") as f:
                page = json.load(f)
            for b, block in enumerate(page["blocks"], 1):
                for n, line in enumerate(block["lines"], 1):
                    spans = [{"text": s["text"], "size": float(s["size"]), **{k: bool(s.get(k)) for k in ("bold", "italic", "sup", "sub")}} for s in line["spans"]]
                    solid = [s for s in spans if s["text"].strip()]
                    yield (page["book_id"], int(page["page"]), b, n, "".join(s["text"] for s in spans), *map(float, line["bbox"]), max((s["size"] for s in solid), default=0.0), bool(solid) and all(s["bold"] for s in solid), bool(solid) and all(s["italic"] for s in solid), spans)
        except (OSError, ValueError, KeyError, TypeError):
            yield (os.path.basename(file), None, None, None, None, None, None, None, None, None, None, None, None)


class LayoutSource(DataSource):
    """``spark.read.format("book_layout").load(folder)``: page lines out of layout files on a local or mounted disk. A decoder of page images or print files
    writes them. ``read_layout`` reads from any file system that Spark knows."""

    @classmethod
    def name(cls) -> str:
        return "book_layout"

    def schema(self) -> T.StructType:
        return LINES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LayoutReader(self.options)


PAGE = "book_id STRING, page INT, blocks ARRAY<STRUCT<lines: ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, spans: ARRAY<STRUCT<text: STRING, size: DOUBLE, bold: BOOLEAN, italic: BOOLEAN, sup: BOOLEAN, sub: BOOLEAN>>>>>>"


def read_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Page lines out of layout files, with the columns of ``LINES``: Spark lists the files and puts many of them into a task. A file that can't be read gives
    one line without text, named after it."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    pages = files.withColumn("p", F.from_json("value", PAGE))
    good = F.col("p.book_id").isNotNull() & F.col("p.page").isNotNull() & F.col("p.blocks").isNotNull()
    blocks = pages.where(good).select("p.book_id", "p.page", F.posexplode("p.blocks").alias("b", "block"))
    lines = blocks.select("book_id", "page", (F.col("b") + 1).alias("block_seq"), F.posexplode("block.lines").alias("n", "line"))
    spans = F.transform("line.spans", lambda s: F.struct(s["text"].alias("text"), s["size"].alias("size"), *(F.coalesce(s[k], F.lit(False)).alias(k) for k in ("bold", "italic", "sup", "sub"))))
    lines = lines.select("book_id", "page", "block_seq", (F.col("n") + 1).alias("line_no"), F.col("line.bbox").alias("box"), spans.alias("spans"))
    solid = F.filter("spans", lambda s: F.btrim(s["text"]) != "")
    styled = [((F.size(solid) > 0) & (F.size(F.filter(solid, lambda s: s["bold"])) == F.size(solid))).alias("bold"), ((F.size(solid) > 0) & (F.size(F.filter(solid, lambda s: s["italic"])) == F.size(solid))).alias("italic")]
    rows = lines.select(
        "book_id", "page", "block_seq", "line_no", F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"), *(F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))),
        F.coalesce(F.array_max(F.transform(solid, lambda s: s["size"])), F.lit(0.0)).alias("size"), *styled, "spans",
    )
    bad = pages.where(~F.coalesce(good, F.lit(False))).select(F.col("file").alias("book_id"))
    return rows.unionByName(bad, allowMissingColumns=True)


def write_tables(tables: DataFrame, small: str, large: str) -> None:
    """Analysed tables (book_id, block_id, large, markdown): those of more than 40 rows go to files of their own, a folder for each book."""
    for big, path in ((False, small), (True, large)):
        tables.where(F.col("large") == F.lit(big)).select("book_id", "block_id", "markdown").repartition("book_id").sortWithinPartitions("book_id", "block_id").write.mode("overwrite").partitionBy("book_id").json(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LayoutSource)


def read_source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size, error) of source files; encrypted ones and those that aren't print files are kept apart by ``error``. Empty files give
    no row: Spark has no split for them."""
    files = spark.read.format("binaryFile").load(folder)
    head = F.decode(F.substring("content", 1, 5), "iso-8859-1")
    error = F.when(head != "%PDF-", "unknown format").when(F.locate("/Encrypt", F.decode(F.substring("content", -2048, 2048), "iso-8859-1")) > 0, "encrypted")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), error.alias("error"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines, by a fixed schema."""
    return spark.read.schema(CHUNKS).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, a folder for each chapter, in their order."""
    chunks.select("book_id", "chapter", "section", "chunk", "section_id", "path", "pages", "refs", "content_type", "text").repartition("book_id", "chapter").sortWithinPartitions("book_id", "chapter", "section", "chunk").write.mode("overwrite").json(path)


def write_states(pages: DataFrame, path: str) -> None:
    """States of pages; only the chapters in ``pages`` are replaced, each as a whole and at once."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "chapter").parquet(path)


def write_markdown(chapters: DataFrame, path: str) -> None:
    """Each chapter as a text file in a folder of its own."""
    chapters.select("book_id", "chapter", F.col("markdown").alias("value")).repartition("book_id", "chapter").write.mode("overwrite").partitionBy("book_id", "chapter").option("lineSep", "\n").text(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.repartition("book_id", "chapter").sortWithinPartitions("book_id", "chapter", "severity", "code").write.mode("overwrite").json(path)


def zip_files(root: str, files: DataFrame, dest: str) -> int:
    """Writes the selected files (path) under ``root`` to an archive on the driver; file lists of one book are small."""
    paths = sorted(r.path for r in files.toLocalIterator())
    with zipfile.ZipFile(dest, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            z.write(os.path.join(root, p), p)
    return len(paths)
