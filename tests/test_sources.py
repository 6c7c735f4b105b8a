import json
import zipfile

from foliospark.operators.assembly import export_files
from foliospark.sources import layout as Z


def test_layout_source(spark, tmp_path):
    page = {"book_id": "b", "page": 1, "blocks": [{"lines": [{"bbox": [1, 2, 3, 4], "spans": [{"text": "a ", "size": 10, "bold": True}, {"text": "b", "size": 8}]}]}]}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    (tmp_path / "p2.json").write_text("{broken")
    Z.register(spark)
    rows = sorted(spark.read.format("book_layout").load(str(tmp_path)).collect(), key=lambda r: r.text or "")
    assert rows[0].text is None and rows[0].book_id == "p2.json"
    assert (rows[1].text, rows[1].size, rows[1].bold, rows[1].x1) == ("a b", 10.0, False, 3.0)


def test_source_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 /Encrypt 1")
    (tmp_path / "d.pdf").write_bytes(b"hello")
    got = {r.path[-5:]: r.error for r in Z.read_source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "c.pdf": "encrypted", "d.pdf": "unknown format"}


def test_states_replace_only_their_chapters(spark, tmp_path):
    path = str(tmp_path / "states")
    schema = "book_id STRING, chapter INT, page INT, v STRING"
    Z.write_states(spark.createDataFrame([("b", 1, 1, "old"), ("b", 2, 1, "old")], schema), path)
    Z.write_states(spark.createDataFrame([("b", 2, 1, "new")], schema), path)
    assert {(r.chapter, r.v) for r in spark.read.parquet(path).collect()} == {(1, "old"), (2, "new")}


def test_chunks_and_export(spark, tmp_path):
    chunk = [("b", 1, 1, 1, "s", ["p"], [1], [2], "text", "t")]
    df = spark.createDataFrame(chunk, Z.CHUNKS)
    Z.write_chunks(df, str(tmp_path / "rag"))
    assert Z.read_chunks(spark, str(tmp_path / "rag")).collect() == df.collect()
    files = spark.createDataFrame([("rag/chunks.jsonl",), (".state/x",), ("chapters/ch_001_a.md",), ("source/b.pdf",), ("reports/ch_001_conversion_report.md",)], "path STRING")
    assert {r.path for r in export_files(files, "all").collect()} == {"rag/chunks.jsonl", "chapters/ch_001_a.md", "reports/ch_001_conversion_report.md"}
    assert {r.path for r in export_files(files, "chapter", 1).collect()} == {"chapters/ch_001_a.md", "reports/ch_001_conversion_report.md"}
    (tmp_path / "one.txt").write_text("x")
    assert Z.zip_files(str(tmp_path), spark.createDataFrame([("one.txt",)], "path STRING"), str(tmp_path / "o.zip")) == 1
    assert zipfile.ZipFile(tmp_path / "o.zip").namelist() == ["one.txt"]


def test_read_layout_as_the_data_source(spark, tmp_path):
    line = {"bbox": [1, 2, 3, 4], "spans": [{"text": "a ", "size": 10, "bold": True}, {"text": " ", "size": 30}, {"text": "b", "size": 8, "bold": True, "sup": True}]}
    for i in range(5):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"book_id": "b", "page": i, "blocks": [{"lines": [line, {"bbox": [0, 0, 1, 1], "spans": []}]}, {"lines": []}]}))
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "none.txt").write_text("no page")
    Z.register(spark)
    old = spark.read.format("book_layout").option("filesPerTask", 2).load(str(tmp_path))
    new = Z.read_layout(spark, str(tmp_path)).select(old.columns)
    assert old.rdd.getNumPartitions() == 3
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect())) and new.count() == 11


def test_large_tables_have_files_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([("b", "1", False, "| a |"), ("b", "2", True, "| b |")], "book_id STRING, block_id STRING, large BOOLEAN, markdown STRING")
    Z.write_tables(df, str(tmp_path / "s"), str(tmp_path / "l"))
    assert [r.block_id for r in spark.read.json(str(tmp_path / "l")).collect()] == ["2"] and [r.block_id for r in spark.read.json(str(tmp_path / "s")).collect()] == ["1"]


def test_a_recogniser_can_be_set(spark):
    from foliospark.operators import assembly as A

    pages = spark.createDataFrame([("b", 1, 3, 1), ("b", 2, 900, 1)], "book_id STRING, page INT, native_chars INT, images INT")
    assert A.recognise(pages) is None
    A.set_recogniser(lambda p: p.selectExpr("book_id", "page", "1 as block", "1 as par", "1 as line", "1 as word_no", "'read' as text", "90d as conf"))
    try:
        assert [tuple(r) for r in A.recognise(pages).collect()] == [("b", 1, "read", 0.9)]
    finally:
        A.set_recogniser(None)
