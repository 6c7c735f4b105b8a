import pytest

from foliospark.llm import ocr as O

BLOCKS = "book_id STRING, block_id STRING, block_type STRING, page INT, block_seq INT, raw_text STRING, cleaned_text STRING, ocr BOOLEAN, text STRING, word STRING"
BASE = ["Risk of fatigue doubles when night sweats exceed the limit of twice-daily dressing.", "Treatment of chronic disease begins with careful monitoring and low-salt food.", "The histology of the membrane shows a thickened medulla in most patients with night sweats.", "Clinicians observe recovery after careful monitoring of patients and twice-daily dressing."]


def blocks(spark, cases):
    rows = [("b", f"ch001-p0001-b{i:03d}", "paragraph", 1, i, BASE[i % 4], BASE[i % 4], False, None, None) for i in range(200)]
    rows += [("b", f"ch002-p0007-b{i:03d}", "paragraph", 7, i, raw, cleaned, True, "clash", "clash") for i, (raw, cleaned) in enumerate(cases)]
    return spark.createDataFrame(rows + rows[-len(cases) :], BLOCKS)


CASES = [
    ("The n1ght sweats of\npatients", "The night sweats of patients"),
    ("Care of mem-\nbrane and twice-\ndaily dressing", "Care of mem- brane and twice-daily dressing"),
    ("Care of mem\u00ad\nBook of Skin | 7\nbrane here", "Care of mem- BOOK OF SKIN 7 brane here"),
    ("Page 7\nMost patients", "Most Page 7 patients"),
    ("Most\n– 7 –\npatients of 7 disease", "Most – 7 – patients of 7 disease"),
    ("Most [7] patients", "Most [7] patients"),
    ("The nigbt sweats of patients", None),
    ("vitamin B12 and marker p53 of free T3", "vitamin B12 and marker p53 of free T3"),
    ("", ""),
    ("x" * 20000 + " fatigue", "word " * 20000),
    ("The derm1s thick-\nened medu11a", "thick-ened medulla"),
]


@pytest.fixture(scope="module")
def repair(spark):
    books = spark.createDataFrame([("b", "Book of Skin"), ("b", "Book of Skin"), ("c", None)], "book_id STRING, title STRING")
    chapters = spark.createDataFrame([("b", 2, "Limits of care"), ("b", 1, "Most patients"), ("b", 3, None)], "book_id STRING, number INT, title STRING")
    return O.Repair(blocks(spark, CASES), books, chapters)


def test_found(repair):
    rows = [tuple(r) for r in repair.found().collect()]
    assert len(rows) == len(set(rows))
    got = {}
    for field, _, block, fault in rows:
        got.setdefault((int(block[-3:]), field), set()).add(fault)
    assert got == {
        (0, "raw_text"): {"misread"},
        (1, "raw_text"): {"hyphen"}, (1, "cleaned_text"): {"hyphen"},
        (2, "raw_text"): {"hyphen", "running"}, (2, "cleaned_text"): {"hyphen", "running"},
        (3, "raw_text"): {"running"}, (3, "cleaned_text"): {"running"},
        (4, "raw_text"): {"running"}, (4, "cleaned_text"): {"running"},
        (6, "raw_text"): {"misread"},
        (10, "raw_text"): {"hyphen", "misread"}, (10, "cleaned_text"): {"hyphen"},
    }


def test_repaired(repair):
    got = {int(r.block_id[-3:]): r.text for r in repair.repaired().collect()}
    assert got[0] == "The night sweats of patients"
    assert got[1] == "Care of membrane and twice-daily dressing"
    assert got[2] == "Care of membrane here"
    assert got[3] == "Most patients" and got[4] == "Most patients of 7 disease" and got[8] == ""
    assert got[6] == "The night sweats of patients" and got[7] == CASES[7][0]


def test_rare_words_that_occur_only_divided(spark):
    cases = [
        ("Signs of xantho-\nchromia here", "Signs of xantho- chromia here"),
        ("Curve of Kaplan-\nMeier here", None),
        ("Signs of night-\nrecovery here", "Signs of night-recovery here"),
        ("Signs of xanthelas-\nma here", None),
        ("Care of mem-\nFoot of page\nbrane here", None),
        ("Signs of low-\nhistology here", None),
        ("A v-\nplasty here", None),
    ]
    empty = "book_id STRING, number INT, title STRING"
    r = O.Repair(blocks(spark, cases), spark.createDataFrame([], "book_id STRING, title STRING"), spark.createDataFrame([], empty))
    got = {(int(x.block_id[-3:]), x.field_name) for x in r.found().where("fault = 'hyphen'").collect()}
    assert got == {(0, "raw_text"), (0, "cleaned_text"), (3, "raw_text"), (4, "raw_text")}
    texts = {int(x.block_id[-3:]): x.text for x in r.repaired().collect() if x.block_id.startswith("ch002")}
    assert texts[0] == "Signs of xanthochromia here" and texts[1] == "Curve of Kaplan-Meier here" and texts[2] == "Signs of night-recovery here"


def test_empty(spark):
    empty = spark.createDataFrame([], BLOCKS)
    books = spark.createDataFrame([], "book_id STRING, title STRING")
    chapters = spark.createDataFrame([], "book_id STRING, number INT, title STRING")
    r = O.Repair(empty, books, chapters)
    assert r.found().count() == 0 and r.repaired().count() == 0


def test_variants():
    assert O.variants("n1ght")["night"] == 1 and O.variants("medu11a")["medulla"] == 2 and O.variants("lirnits")["limits"] == 1
    assert "abc" not in O.variants("abc")


CLAY = ["Pots of wet clay stand near the kiln.", "He dug the clay from a deep bank.", "A brick of clay is fired for hours."]
DAY = ["Take one tablet each day with food.", "On the third day of treatment she slept.", "Every day of treatment he takes food."]
MORE = ["Wash the wound with water before sleep.", "Most patients of the ward slept well.", "Water and food are given in the ward."]


def test_real_words_are_read_in_their_context(spark):
    cases = [("On the third clay of treatment he slept.", "Every clay of treatment she takes food."), ("Pots of wet clay stand near the kiln.", "He dug the clay from a deep bank."), ("On the third day of treatment she slept.", None), ("On the third clay of treatment\nhe saw pots of wet clay stand", None)]
    rows = [("b", f"ch001-p0001-b{i:04d}", "paragraph", 1, i, (CLAY + DAY + MORE)[i % 9], None, False, None, None) for i in range(900)]
    rows += [("b", f"ch002-p0007-b{i:04d}", "paragraph", 7, i, raw, cleaned, True, "clash", "clash") for i, (raw, cleaned) in enumerate(cases)]
    none = spark.createDataFrame([], "book_id STRING, title STRING"), spark.createDataFrame([], "book_id STRING, number INT, title STRING")
    df = spark.createDataFrame(rows, BLOCKS)
    r = O.Repair(df, *none)
    got = {(int(x.block_id[-4:]), x.field_name) for x in r.found().where("fault = 'misread'").collect()}
    assert got == {(0, "raw_text"), (0, "cleaned_text"), (3, "raw_text")}
    texts = {int(x.block_id[-4:]): x.text for x in r.repaired().collect()}
    assert texts[0] == "On the third day of treatment he slept." and texts[1] == cases[1][0]
    assert texts[3] == "On the third day of treatment he saw pots of wet clay stand"
    # Without the vectors no count tells them apart.
    assert O.Repair(df, *none, vectors=False).found().where("fault = 'misread'").count() == 0


def test_readings_at_any_length(spark):
    stem = "".join(chr(97 + (7 * i * i + i) % 26) for i in range(60))
    words = ["n1ght", "medu11a", stem[:30] + "rn" + stem[30:50] + "1" + stem[50:], stem[:45] + "m", "x" * 20000 + "1", "1l" * 3000]
    known = ["night", "medulla", stem[:30] + "m" + stem[30:50] + "l" + stem[50:], stem[:45] + "in", "x" * 20000 + "l", "x" * 20000, "il" * 3000]
    got = {tuple(r) for r in O.readings(spark.createDataFrame([(w,) for w in words], "word STRING"), spark.createDataFrame([(w,) for w in known], "word STRING")).collect()}
    assert {(w, r, O.edits_between(w, r)) for w in words for r in known if O.edits_between(w, r)} == got
    assert {(w[:5], n) for w, _, n in got} == {("n1ght", 1), ("medu1", 2), (stem[:5], 2), (stem[:5], 1), ("xxxxx", 1)}


def test_edits_between_as_variants():
    for w in ("n1ght", "medu11a", "lirnits", "clay", "hoiirs", "c1iff", "vvindovv"):
        for r, n in O.variants(w).items():
            assert O.edits_between(w, r) == n, (w, r)
    assert O.edits_between("night", "night") == 0 and O.edits_between("night", "nigh") is None


def test_letters_are_read_anew_only_where_vectors_speak_for_it(spark, repair):
    none = spark.createDataFrame([], "book_id STRING, title STRING"), spark.createDataFrame([], "book_id STRING, number INT, title STRING")
    blind = O.Repair(blocks(spark, CASES), *none, vectors=False)
    misread = {(int(r.block_id[-3:]), r.field_name) for r in blind.found().where("fault = 'misread'").collect()}
    assert misread == {(0, "raw_text"), (10, "raw_text")}
    assert {(int(r.block_id[-3:]), r.field_name) for r in repair.found().where("fault = 'misread'").collect()} == misread | {(6, "raw_text")}
