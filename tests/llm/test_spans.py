import random

import pytest

from foliospark.llm.spans import SharedSpans
from foliospark.session import table


def brute(docs, n):
    """Pairs with a common run, and of each text the places that stand in another record."""
    windows = {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            windows.setdefault(t[k : k + n], {}).setdefault(i, set()).add(k)
    pairs, shared = set(), {}
    for held in windows.values():
        if len(held) > 1:
            ids = sorted(held)
            pairs |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
            for i in ids:
                shared.setdefault(i, set()).update(p for s in held[i] for p in range(s, s + n))
    return pairs, {i: len(p) for i, p in shared.items()}


def made(seed=3):
    r = random.Random(seed)

    def text(n):
        return "".join(r.choice("abcdefghij é\n") for _ in range(n))

    passage, short, notice = text(60), text(39), text(45)
    docs = [(i, text(r.randint(0, 300))) for i in range(40)]
    docs += [(100 + i, text(i) + passage + text(50 - i)) for i in range(5)]
    docs += [(200 + i, text(30) + short + text(30)) for i in range(5)]
    docs += [(300 + i, text(7 * i) + notice + text(20)) for i in range(30)]
    docs += [(400 + i, docs[0][1] + passage) for i in range(3)]
    docs += [(500, passage[:40]), (501, passage[20:] + text(10)), (502, notice + passage), (503, None), (504, ""), (505, "x" * 500), (506, "y" + "x" * 90), (507, "ab" * 100), (508, "ba" * 30)]
    docs += [(600, text(20) + passage + text(5) + passage[10:55])]
    return docs


@pytest.mark.parametrize("hot", [1000, 3])
def test_same_as_brute_force(spark, hot):
    docs = made()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs + docs[:3]], "doc_id LONG, text STRING, cls STRING, id STRING").repartition(3)
    s = SharedSpans(df, min_chars=40, window=20, hot=hot)
    pairs, shared = brute(docs, 40)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r.id: r.shared_chars for r in s.report().collect()} == shared


def test_small_tables_as_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    pairs, shared = brute(docs, 240)
    s = SharedSpans(table(spark, data, "documents"))
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    assert {r.id: r.shared_chars for r in s.report().collect()} == shared


def test_long_texts_are_cut_with_an_overlap(spark, monkeypatch):
    from foliospark.llm import spans

    monkeypatch.setattr(spans, "_CHUNK", 1 << 9)
    codes = {}
    r = random.Random(1)
    text = "".join(r.choice("abcd ") for _ in range(5000))
    whole = list(spans._chunks([1], [text], 39))
    for _, _, off, part in whole:
        codes[int(off[0])] = part
    assert all(text[o : o + len(p)] == p for o, p in codes.items()) and max(o + len(p) for o, p in codes.items()) == 5000
    starts = sorted(codes)
    assert all(b - a == (1 << 9) - 39 for a, b in zip(starts, starts[1:]))


def test_windows_of_one_first_hash_are_told_apart(spark, monkeypatch):
    """A first hash that takes all windows for equal leaves it to the second one."""
    from foliospark.llm import spans

    monkeypatch.setattr(spans, "_SPLIT", 4)
    docs = made()
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(3)
    code = spans._run_windows(40, 20, (12345, 67891))

    def same_first(batches):
        import pyarrow as pa

        for b in code(batches):
            yield pa.RecordBatch.from_arrays([pa.array([1] * b.num_rows, pa.int64()), *b.columns[1:]], names=b.schema.names)

    monkeypatch.setattr(spans, "_run_windows", lambda *a: same_first)
    s = spans.SharedSpans(df, min_chars=40, window=20, hot=3)
    pairs, shared = brute(docs, 40)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    assert {r.id: r.shared_chars for r in s.report().collect()} == shared


def test_prime_windows():
    import numpy as np

    from foliospark.llm import spans

    codes = spans._codes("abcabcabdabcé\U0001f9ba" * 40)
    h = spans.prime_windows(codes, 5, (98765, 43210))
    by = {}
    for i, x in enumerate(h.tolist()):
        by.setdefault(x, set()).add(codes[i : i + 5].tobytes())
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({codes[i : i + 5].tobytes() for i in range(len(codes) - 4)})
    assert spans.prime_windows(codes[:3], 5, (7, 9)).size == 0 and h.dtype == np.int64


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id LONG, text STRING")
    s = SharedSpans(df)
    assert s.pairs().count() == 0 and s.report().count() == 0
    with pytest.raises(ValueError):
        SharedSpans(df, min_chars=10, window=10)
