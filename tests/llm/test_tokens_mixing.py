import math
import os

import numpy as np
import pytest

from foliospark.llm import mixing as M
from foliospark.llm import tokens as K
from foliospark.session import table

TEXTS = [None, "", " ", "plain words here", "don't we'll I'LL it's", "  two\n\n  blanks\t\tand \x1c\x1d signs", "　　wide　z\x85y", "aaaaaaaaaaaa" * 500, "१२३ ½ Ⅷ ２", "👩‍⚕️🩺 é é ñ", "<|endoftext|>", "a\x00b", "x" * 100_000, "word " * 50_000]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(K.tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(spark, library, data):
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").select("doc_id", "text").collect()] + [(-i - 1, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id LONG, text STRING, ids STRING")
    got = {r.doc_id: list(r.ids) for r in K.encode(df, ["doc_id"]).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in docs}
    counts = {r.doc_id: r.n_tokens for r in K.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id LONG, text STRING")
    assert K.encode(df.limit(0), ["doc_id"]).count() == 0
    assert sorted((r.doc_id or 0, len(r.ids)) for r in K.encode(df, ["doc_id"]).collect()) == [(0, 0), (1, 2), (1, 2)]


def test_cache_starts_afresh(monkeypatch, library):
    monkeypatch.setattr(K, "CACHE_WORDS", 3)
    monkeypatch.setattr(K, "BATCH_CHARS", 20)
    texts = [f"alpha{i} beta{i} gamma delta" for i in range(50)]
    enc = K.CorpusEncoder(K.tokenizer_path())
    ids = [x for _, _, counts, words in enc.batches(texts) for x in enc.ids(words).tolist()]
    assert ids == [x for t in texts for x in library.encode(t).ids]


@pytest.mark.parametrize("mean, cap", [(0.3, 1), (0.9, 1), (1.5, 2), (2.9, 3), (0.01, 5), (4.99, 5)])
def test_rate_is_inverted(mean, cap):
    rate = M.solve_rate(mean, cap)
    steps = M.thresholds(rate, cap)
    assert abs(M.capped_mean(rate, cap) - mean) < 1e-9 and abs(sum(1 - s for s in steps) - mean) < 1e-9


def test_rate_at_the_ends():
    assert M.solve_rate(0, 3) == 0 and M.solve_rate(3, 3) == float("inf") and M.thresholds(float("inf"), 3) == [0.0] * 3


def corpus(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, "word " * (20 + k % 7), source, "clash"))
            i += 1
    rows += [(i, None, "a", None), (i + 1, "", "b", None), (i + 2, "x", None, None), (i + 3, "word " * 50, "unnamed", None)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, n_tokens STRING")


def test_shares_and_repeats(spark):
    docs = corpus(spark, {"a": 600, "b": 60, "c": 300})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.2, 2), ("none", 0.1, 4), (None, 0.3, 1), ("a", 0.1, 9)], "source STRING, target_share DOUBLE, max_repeats INT")
    mix = M.Mixture(docs, targets)
    shares = {r.source: r for r in mix.shares().collect()}
    assert set(shares) == {"a", "b", "c", "none"} and shares["none"].actual_share == 0
    for s, want in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
        assert abs(shares[s].actual_share - want) < 0.01 and shares[s].most_repeats <= shares[s].max_repeats
    copies = mix.copies().collect()
    assert len({(r.doc_id, r.copy_no) for r in copies}) == len(copies) == sum(r.copies for r in shares.values())
    again = M.Mixture(docs.repartition(7), targets).counts().collect()
    assert {(r.doc_id, r.repeats) for r in again} == {(r.doc_id, r.repeats) for r in mix.counts().collect()}


def test_draws_are_of_the_document_alone(spark):
    """Documents keep their numbers when others come: hardly any count changes, and the counts are Poisson."""
    docs = corpus(spark, {"a": 3000, "b": 300})
    targets = spark.createDataFrame([("a", 0.7, 6), ("b", 0.3, 6)], "source STRING, target_share DOUBLE, max_repeats INT")
    new = spark.createDataFrame([(10_000, "word " * 23, "a", None)], docs.schema)
    one, two = ({r.doc_id: r.repeats for r in M.Mixture(d, targets).counts().collect()} for d in (docs, docs.union(new)))
    moved = [i for i in set(one) | set(two) if i != 10_000 and one.get(i) != two.get(i)]
    assert len(moved) <= 12  # the new one is drawn up to six times, and as many copies of others go
    n = [one.get(i, 0) for i in range(3000)]
    mean = sum(n) / 3000
    for k in range(3):
        expected = 3000 * math.exp(-mean) * mean**k / math.factorial(k)
        assert abs(n.count(k) - expected) < 5 * math.sqrt(expected) + 1, (k, n.count(k), expected)


def test_copies_hold_their_texts(spark):
    docs = corpus(spark, {"a": 50, "b": 20})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source STRING, target_share DOUBLE, max_repeats INT")
    mix = M.Mixture(docs, targets)
    text = {r.doc_id: r.text for r in docs.collect()}
    counts = {r.doc_id: r.repeats for r in mix.counts().collect()}
    copies = mix.copies().collect()
    assert all(r.text == text[r.doc_id] and 1 <= r.copy_no <= r.repeats == counts[r.doc_id] for r in copies)
    assert len(copies) == sum(counts.values())


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_calibrated_steps_draw_what_is_wanted(cap):
    r = np.random.default_rng(1)
    tokens = np.append(r.integers(0, 50, M.BINS) * (r.random(M.BINS) < 0.05), 0).astype(float)
    above = tokens[::-1].cumsum()[::-1]
    for share in (0.001, 0.3, 0.9 * cap, cap, 2 * cap):
        steps = M.calibrate(above, share * above[0], cap)
        assert abs(M.drawn(above, steps) - min(share, cap) * above[0]) < 1e-6 * above[0] + 50
    assert M.calibrate(np.zeros(M.BINS + 1), 5, cap) == []


def test_fixed_total_is_met_as_far_as_repeats_allow(spark):
    docs = corpus(spark, {"a": 200, "b": 20})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    shares = {r.source: r for r in M.Mixture(docs, targets, total=6000).shares().collect()}
    assert shares["b"].copies == 40 and abs(shares["a"].tokens - 3000) < 60


def test_empty_mixture(spark):
    docs = corpus(spark, {"a": 3})
    targets = spark.createDataFrame([("a", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    assert M.Mixture(docs.limit(0), targets).copies().count() == 0
    assert M.Mixture(docs, targets.limit(0)).shares().count() == 0
    assert os.path.exists(K.tokenizer_path())
