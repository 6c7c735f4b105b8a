"""Noise in text from scanned pages (problem 4).

Method: skip-gram vectors are learned from all blocks; words of scanned blocks are linked to known words from which they differ by plausible
glyph edits; each occurrence is then read in its context; running lines are removed and the lines reflowed.

Reading in context: an occurrence of ``w`` is taken for ``r`` if ``log(g_r) - EDIT_COST * edits + S(r)`` exceeds ``log(g_w + unseen) + S(w)``. ``g`` is
the number of genuine uses to be expected in scanned text: what blocks that aren't scanned show, or what misreadings can't explain. ``S`` is
the sum over the ``SPAN`` words on either side of the product of skip-gram vectors of word and context word, which is the logarithm of how much
more often than by chance the two meet. So the same word may be right in one place and misread in another. A word of letters alone is only
read anew where its context speaks for the reading, whatever the counts say.

Vectors: contexts are classes of words, the ``TOP_CLASSES`` most frequent ones each alone, all others by hash, so that their vectors have a fixed size
and are passed to every task. They are trained with negative sampling in its expectation on the counts of class pairs of the whole corpus
(a square of at most the number of classes, in one task). With these fixed, the vector of every word in a link is learned from its own
context counts: as a reading from all blocks, as a word in its own right from the blocks that aren't scanned, so that a misreading doesn't
vouch for itself. Counts are over the rows of the table as they stand; repeated rows count again there, but never make two cases.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.glyphs import form_of
from foliospark.session import BROADCAST_ROWS, ensure_checkpoint_dir, ship

# Glyphs that scanners take for each other, as read and as printed.
GLYPH_EDITS = [
    ("1", "i"), ("1", "l"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("+", "t"), ("0", "o"), ("9", "g"), ("6", "b"), ("8", "b"), ("$", "s"), ("@", "a"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("ii", "u"), ("u", "ii"), ("c", "e"), ("e", "c"), ("cl", "d"), ("d", "cl"), ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("n", "ri"), ("ri", "n"), ("li", "h"), ("h", "li"),
    ("in", "m"), ("m", "in"), ("nn", "m"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("g", "q"), ("q", "g"), ("tl", "d"), ("ti", "h"), ("lc", "k"), ("k", "lc"),
]
SPAN = 2
#: Cost of a glyph edit, as the logarithm of its odds.
EDIT_COST = 5.0
#: Genuine uses allowed in unscanned text to a word that it doesn't show: of letters only or short, and with a sign or digit among more than three
#: glyphs. In scanned text as many in proportion, but not more.
UNSEEN, UNSEEN_MIXED = 0.5, 0.00001
#: A word of scanned text may be a misreading as far as it is met at most so often, and at most in this share of the uses of its reading.
MOST_MISREAD, LEAST_OWN = 0.03, 10
#: Letters from which a word may hold two edits; below, two edits make another word of most.
TWO_EDITS_FROM = 6
#: Letters up to which readings are made up from the word; readings of longer words are looked up among known words by common parts.
SHORT_WORD = 40
#: Bounds of the contribution of one context word, and of all.
CONTEXT_BOUNDS, TOTAL_BOUNDS = (-1.0, 3.0), (-2.0, 6.0)
#: Classes of context words: frequent words, hash buckets of all others; class 0 is the edge of a text. Length of a vector, steps of training.
TOP_CLASSES, BUCKETS, DIMENSIONS, STEPS = 1024, 255, 32, 60
#: Words up to which a set is passed to the tasks to leave out others early (some 2 MB); beyond, the join that follows does it.
PASSED_WORDS = 100_000
_WORD = r"[\p{L}\p{N}|!+$@]++(?:-[\p{L}\p{N}|!+$@]++)*+"
#: A word before a hyphen, taken as a whole: no match begins inside a word, so a word is looked at once.
_BREAK = r"(?<![\p{L}\p{N}|!+$@])([\p{L}\p{N}|!+$@]++)-"



def variants(word: str, edits: int = 2) -> dict[str, int]:
    """Readings of a word and the number of glyph edits to each. The second edit stands behind the first."""
    out: dict[str, int] = {}

    def walk(at: int, done: str, used: int) -> None:
        for i in range(at, len(word)):
            for seen, true in _BY_FIRST.get(word[i], ()):
                if word.startswith(seen, i):
                    head = done + word[at:i] + true
                    full = head + word[i + len(seen) :]
                    if full != word and out.get(full, 9) > used + 1:
                        out[full] = used + 1
                    if used + 1 < edits:
                        walk_from.append((i + len(seen), head, used + 1))

    walk_from = [(0, "", 0)]
    while walk_from:
        walk(*walk_from.pop())
    return out


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _seen, _true in GLYPH_EDITS:
    _BY_FIRST.setdefault(_seen[0], []).append((_seen, _true))


def edits_between(word: str, reading: str, most: int = 2) -> int | None:
    """Least number of glyph edits from one to the other, None if more than ``most``. No edit keeps its first glyph, so each begins where the
    two first differ; a text of any length is walked once for each choice."""
    best = None
    open_ = [(0, 0, 0)]
    while open_:
        i, j, used = open_.pop()
        n = _common(word, i, reading, j)
        i, j = i + n, j + n
        if i == len(word) and j == len(reading):
            best = used if best is None else min(best, used)
        elif used < most and i < len(word):
            open_ += [(i + len(seen), j + len(true), used + 1) for seen, true in _BY_FIRST.get(word[i], ()) if word.startswith(seen, i) and reading.startswith(true, j)]
    return best


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the common beginning of a[i:] and b[j:]."""
    n, done = min(len(a) - i, len(b) - j), 0
    if a[i : i + n] == b[j : j + n]:
        return n
    while n > 1:
        half = n // 2
        if a[i + done : i + done + half] == b[j + done : j + done + half]:
            done, n = done + half, n - half
        else:
            n = half
    return done


def _plausible(word: str, reading: str, edits: int) -> bool:
    return reading.isalpha() and (edits == 1 or len(word) >= TWO_EDITS_FROM)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, reads, edits = [], [], []
        for w in b.column(0).to_pylist():
            for r, n in variants(w).items():
                if _plausible(w, r, n):
                    words.append(w)
                    reads.append(r)
                    edits.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(reads, pa.string()), pa.array(edits, pa.int32())], names=["word", "reading", "edits"])


def _part_key(length: int, no: int, part: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{length} {no} {part}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _parts(n: int) -> list[tuple[int, int]]:
    return [(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]


def _known_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each known word under its three thirds. Two edits leave one of them whole."""
    for b in batches:
        rows = [(_part_key(len(w), no, w[s:e]), w) for w in b.column(0).to_pylist() for no, (s, e) in enumerate(_parts(len(w)))]
        keys, words = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["part", "reading"])


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under the thirds of the words it may be read as: an edit moves and lengthens what follows by one glyph at most."""
    for b in batches:
        rows = set()
        for w in b.column(0).to_pylist():
            for n in range(len(w) - 2, len(w) + 3):
                for no, (s, e) in enumerate(_parts(n)):
                    rows |= {(_part_key(n, no, w[s + d : e + d]), w) for d in range(-2, 3) if s + d >= 0 and e + d <= len(w)}
        keys, words = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["part", "word"])


def _check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(w, r, n) for w, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (n := edits_between(w, r)) and _plausible(w, r, n)]
        words, reads, edits = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(reads, pa.string()), pa.array(edits, pa.int32())], names=["word", "reading", "edits"])


_LINK = "word STRING, reading STRING, edits INT"


def readings(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, reading, edits): the words of ``known`` (word) of letters only that are one or two glyph edits from each of ``words`` (word), at any length.
    Readings of short words are made up and looked up; long words meet known words on a third that both have, and are compared."""
    short = words.where(F.length("word") <= SHORT_WORD).mapInArrow(_variants, _LINK).join(known.select(F.col("word").alias("reading")), "reading", "left_semi").select("word", "reading", "edits")
    near = known.where(F.length("word") > SHORT_WORD - 2).mapInArrow(_known_parts, "part LONG, reading STRING")
    long = words.where(F.length("word") > SHORT_WORD).mapInArrow(_word_parts, "part LONG, word STRING")
    return short.union(long.join(near, "part").select("word", "reading").distinct().mapInArrow(_check_pairs, _LINK))


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, in its one form; a mark that stands for a hyphen at a line end is one."""
    for b in batches:
        texts = [t if t is None or t.isascii() and "\t" not in t else form_of(_PY_MARK.sub("-", t)) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=b.schema.names)


def _formed(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_normal, rows.schema)


# The same words as _WORD: letters, digits and the signs that stand for letters, without the underscore.
_GLYPHS = r"(?:[^\W_]|[|!+$@])+"
_PY_WORD = re.compile(rf"{_GLYPHS}(?:-{_GLYPHS})*")
_PY_MARK = re.compile(r"[\xad\xac‐‑](?=\s|$)")
_PY_DIVIDED = re.compile(rf"{_GLYPHS}-[ \t]*\n\s*{_GLYPHS}")
_PY_LINE_END = re.compile(r"-[ \t]*\n")
#: A word divided before a blank, or a word or part of a compound.
# The same as one class of characters, which is found several times as fast, for texts without an underscore.
_FAST_WORD, _FAST_PART = re.compile(r"[\w|!+$@]+(?:-[\w|!+$@]+)*"), re.compile(r"[\w|!+$@]+")
_PY_BODY = re.compile(rf"({_GLYPHS})-\s+({_GLYPHS})|({_GLYPHS})")
_PY_LOOSE = re.compile(rf"(?<![^\W_])(?<![|!+$@])({_GLYPHS})-\s+({_GLYPHS})")
_PY_OVER = re.compile(rf"(?<![^\W_])(?<![|!+$@])({_GLYPHS})-[ \t]*\n[^\n]*\n\s*({_GLYPHS})")
_PY_TIGHT = re.compile(rf"(?<![^\W_])(?<![|!+$@-])({_GLYPHS})-({_GLYPHS})(?![^\W_]|[|!+$@-])")


def _tokens(text: str) -> list[str]:
    """Words of a text in lower case and in their one form; the parts of words divided at line ends aren't words."""
    if not text.isascii():
        text = form_of(_PY_MARK.sub("-", text))
    if _PY_LINE_END.search(text):
        text = _PY_DIVIDED.sub(" ", text)
    return _FAST_WORD.findall(text.lower().replace("_", " "))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in raw texts that aren't scanned, in scanned ones, and in the cleaned texts of these, of a partition as a whole as far as they fit."""

    def out(counts: list[Counter]) -> pa.RecordBatch:
        rows: dict[str, list[int]] = {}
        for k, n in enumerate(counts):
            for w, m in n.items():
                rows.setdefault(w, [0] * 6)[k] += m
                if "-" in w:
                    for part in w.split("-"):
                        rows.setdefault(part, [0] * 6)[3 + k] += m
        cols = list(zip(*rows.values())) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=_COUNTED)

    counts = [Counter() for _ in range(3)]
    for b in batches:
        for raw, ocr, cleaned in zip(*(b.column(i).to_pylist() for i in range(3))):
            if raw:
                counts[ocr].update(_tokens(raw))
            if cleaned:
                counts[2].update(_tokens(cleaned))
        if sum(map(len, counts)) > 300_000:
            yield out(counts)
            counts = [Counter() for _ in range(3)]
    yield out(counts)


_COUNTED = ["word", "clean", "scanned", "cleaned", "clean_part", "scanned_part", "cleaned_part"]


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(word, n, clean, scanned, cleaned): uses of each word by itself in raw texts, and its uses by itself or as a part of a compound in raw texts that
    aren't scanned, in scanned ones, and in the cleaned texts of these."""
    ocr = F.coalesce("ocr", F.lit(False))
    rows = blocks.where("raw_text is not null or cleaned_text is not null").select("raw_text", ocr.alias("ocr"), F.when(ocr, F.col("cleaned_text")).alias("cleaned"))
    counts = rows.mapInArrow(_count_words, ", ".join(f"{c} LONG" if c != "word" else "word STRING" for c in _COUNTED))
    return counts.groupBy("word").agg(F.sum(F.col("clean") + F.col("scanned")).alias("n"), *(F.sum(F.col(k) + F.col(f"{k}_part")).alias(k) for k in ("clean", "scanned", "cleaned")))


class Classes:
    """Classes of context words: 0 the edge of a text, then the most frequent words, then hash buckets of all others."""

    def __init__(self, frequent: list[str]):
        self.of = {w: i for i, w in enumerate(frequent, 1)}
        self.n = 1 + len(frequent) + BUCKETS

    def __call__(self, word: str) -> int:
        c = self.of.get(word)
        if c is None:
            c = 1 + len(self.of) + int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % BUCKETS
        return c


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    keys, at = np.unique(codes, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


_PAIRS = "word STRING, scanned BOOLEAN, a INT, b INT, k LONG"


def _count_pairs(classes: Classes, wanted: frozenset | None):
    """Counts of pairs of classes up to SPAN places apart (in either order, a <= b; word null), and of the classes b around each wanted word (a null)."""

    class Known(dict):
        def __missing__(self, word: str) -> int:
            self[word] = c = classes(word)
            return c

    class Numbers(dict):
        def __missing__(self, word: str) -> int:
            self[word] = i = len(self)
            return i

    def out(codes: np.ndarray, k: np.ndarray, words: list[str] | None) -> pa.RecordBatch:
        high, b = codes // classes.n, codes % classes.n
        word = pa.nulls(len(codes), pa.string()) if words is None else pa.array(np.array(words, object)[high // 2], pa.string())
        a = pa.array(high.astype(np.int32)) if words is None else pa.nulls(len(codes), pa.int32())
        scanned = pa.nulls(len(codes), pa.bool_()) if words is None else pa.array(high % 2 == 1)
        return pa.RecordBatch.from_arrays([word, scanned, a, pa.array(b.astype(np.int32)), pa.array(k)], names=["word", "scanned", "a", "b", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, around = Known(), []
        pairs = np.zeros(classes.n * classes.n, np.int64)
        numbers = Numbers() if wanted is None else {w: i for i, w in enumerate(wanted)}
        for batch in batches:
            seq, who, sizes = [0] * SPAN, [-1] * SPAN, [SPAN]
            for t in batch.column(0).to_pylist():
                words = _tokens(t)
                seq.extend(map(known.__getitem__, words))
                who.extend(map(numbers.__getitem__, words) if wanted is None else map(numbers.get, words, repeat(-1)))
                seq += [0] * SPAN
                who += [-1] * SPAN
                sizes.append(len(words) + SPAN)
            scanned = np.repeat(np.array([False, *batch.column(1).to_pylist()]), sizes)
            x, y = np.array(seq, np.int64), np.array(who, np.int64)
            y = np.where(y < 0, -1, 2 * y + scanned)
            near = []
            for d in range(1, SPAN + 1):
                a, b = x[:-d], x[d:]
                both = (a > 0) & (b > 0)
                pairs += np.bincount((np.minimum(a, b) * classes.n + np.maximum(a, b))[both], minlength=len(pairs))
                for w, c in ((y[:-d], b), (y[d:], a)):
                    hit = (w >= 0) & (c > 0)
                    near.append((w * classes.n + c)[hit])
            around.append(np.unique(np.concatenate(near), return_counts=True))
            if sum(len(p[0]) for p in around) > 2_000_000:
                around = [_merge(around)]
                if len(around[0][0]) > 1_000_000:
                    yield out(*around[0], list(numbers))
                    around = []
            if len(known) > 300_000:
                known = Known()
            if wanted is None and len(numbers) > 300_000:
                yield out(*_merge(around), list(numbers))
                around, numbers = [], Numbers()
        met = np.flatnonzero(pairs)
        yield out(met, pairs[met], None)
        yield out(*_merge(around), list(numbers))

    return run


def _train(n: int):
    """Skip-gram vectors of n classes from the counts of their pairs: ascent on the expectation of the objective with one negative sample a pair,
    ``sum k log s(uv) + e log s(-uv)`` with e the count expected by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.zeros((n, n), np.float32)
        for b in batches:  # each pair stands in one row
            k[b.column(0).to_numpy(), b.column(1).to_numpy()] = b.column(2).to_numpy()
        k += k.T
        total = max(float(k.sum()), 1.0)
        share = k.sum(1) / total
        e = np.outer(share, share).astype(np.float32) * total
        weight = 1 / np.maximum(k.sum(1), 1)[:, None]  # each row counts alike, as its vector is fitted to it alone
        r = np.random.default_rng(4)
        v = [r.normal(0, 0.3, (n, DIMENSIONS)).astype(np.float32) for _ in range(2)]
        m, s = [np.zeros_like(x) for x in v], [np.zeros_like(x) for x in v]
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(v[0] @ v[1].T, -15, 15)))
            g = k - (k + e) * p
            grads = [weight * (g @ v[1]) - 0.002 * v[0], weight * (g.T @ v[0]) - 0.002 * v[1]]
            for i in (0, 1):
                m[i] = 0.9 * m[i] + 0.1 * grads[i]
                s[i] = 0.95 * s[i] + 0.05 * grads[i] ** 2
                v[i] += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.95**step)) + 1e-6)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(list(v[1].astype(np.float32)), pa.list_(pa.float32())), pa.array(share.astype(np.float64))], names=["class", "vector", "share"])

    return run


def fit_words(v: np.ndarray, share: np.ndarray, counts: np.ndarray, steps: int = 8, ridge: float = 0.5) -> np.ndarray:
    """Vectors of words from their context counts (words x classes), the vectors of the classes fixed: Newton steps on the same objective with
    a ridge, which leaves a word without contexts at zero."""
    d = v.shape[1]
    u = np.zeros((len(counts), d))
    met = np.flatnonzero(counts.sum(1))
    squares = (v[:, :, None] * v[:, None, :]).reshape(len(v), d * d).astype(np.float32)  # only the length of a step hangs on it
    for at in np.array_split(met, max(1, len(met) // 256)):
        k = counts[at]
        both = k + share * k.sum(1, keepdims=True)
        x = np.zeros((len(at), d))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ v.T, -15, 15)))
            g = (k - both * p) @ v - ridge * x
            h = ((both * p * (1 - p)).astype(np.float32) @ squares).reshape(-1, d, d).astype(np.float64) + ridge * np.eye(d)
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            x += step * np.minimum(1.0, 4.0 / (np.abs(step).max(1, keepdims=True) + 1e-9))
            if np.abs(step).max() < 1e-4:
                break
        u[at] = x
    return u


def _fit(v: np.ndarray, share: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            out = []
            for use in ("k", "clean"):
                counts = np.zeros((len(words), len(v)))
                for i, ctx in enumerate(b.column(1).to_pylist()):
                    for x in ctx:
                        counts[i, x["b"]] = x[use]
                out.append(pa.array(list(fit_words(v, share, counts).astype(np.float32)), pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *out], names=["word", "as_reading", "as_word"])

    return run


class SkipGram:
    """Vectors of context classes over all blocks (``v``, few and of fixed size) and of the words asked for (``words``: word, as_reading, as_word)."""

    def __init__(self, blocks: DataFrame, counts: DataFrame, wanted: DataFrame):
        # At most TOP_CLASSES words and that many vectors come to the driver.
        self.classes = Classes([r.word for r in counts.where("n > 0").orderBy(F.desc("n"), "word").limit(TOP_CLASSES).collect()])
        n, rows = self.classes.n, blocks.where("raw_text is not null").select("raw_text", F.coalesce("ocr", F.lit(False)).alias("ocr"))
        few = wanted.count() <= PASSED_WORDS
        passed = frozenset(r.word for r in wanted.collect()) if few else None
        pairs = rows.mapInArrow(_count_pairs(self.classes, passed), _PAIRS).groupBy("word", "a", "b").agg(F.sum("k").alias("k"), F.sum(F.when(~F.col("scanned"), F.col("k")).otherwise(0)).alias("clean")).checkpoint()
        trained = pairs.where("word is null").select("a", "b", "k").coalesce(1).mapInArrow(_train(n), "class INT, vector ARRAY<FLOAT>, share DOUBLE").orderBy("class").collect()
        self.v = np.array([r.vector for r in trained], np.float64)
        self.share = np.array([r.share for r in trained])
        around = pairs.where("word is not null").select("word", F.struct("b", "k", "clean").alias("c"))
        if not few:
            around = around.join(wanted, "word", "left_semi")
        around = around.groupBy("word").agg(F.collect_list("c").alias("c"))
        self.words = around.mapInArrow(_fit(self.v, self.share), "word STRING, as_reading ARRAY<FLOAT>, as_word ARRAY<FLOAT>")


def _scores(v: np.ndarray, vectors: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """S of each row: the bounded sum over its contexts (classes, 0 for none)."""
    x = np.clip(np.einsum("nd,ncd->nc", vectors, v[contexts]), *CONTEXT_BOUNDS)
    return np.clip((x * (contexts > 0)).sum(1), *TOTAL_BOUNDS)


def _decide(v: np.ndarray):
    """The occurrences that are misread, each with its best reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = [0.0] * DIMENSIONS
        for b in batches:
            n = b.num_columns - 3
            who, reads, best = [], [], []
            ctx, own, links = (b.column(n + i).to_pylist() for i in range(3))
            rows = [i for i, l in enumerate(links) for _ in l]
            if rows:
                c = np.array([ctx[i] for i in rows])
                flat = [x for l in links for x in l]
                support = _scores(v, np.array([x["vector"] or zero for x in flat]), c) - _scores(v, np.array([own[i] or zero for i in rows]), c)
                gain = np.array([x["prior"] for x in flat]) + support
                for i, x, g, s in sorted(zip(rows, flat, gain, support), key=lambda y: (y[0], -y[2], y[1]["reading"])):
                    if g > 0 and (s > 0 or not x["letters"]) and (not who or who[-1] != i):
                        who.append(i)
                        reads.append(x["reading"])
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), pa.array(reads, pa.string())], names=[*b.schema.names[:n], "reading"])

    return run


def _around(text: str, start: int, end: int, classes: Classes) -> list[int]:
    """Classes of the SPAN words before and behind a place."""
    before = _PY_WORD.findall(text[max(0, start - 80) : start])[-SPAN:]
    behind = _PY_WORD.findall(text[end : end + 80])[:SPAN]
    c = [classes(w.lower()) for w in before], [classes(w.lower()) for w in behind]
    return [0] * (SPAN - len(c[0])) + c[0] + c[1] + [0] * (SPAN - len(c[1]))


def _body_words(body: str) -> Iterator[tuple[str, int, int, int]]:
    """(word, ordinal, start, end) of the words and parts of compounds of a body; the ordinal counts the same word. Words divided before a blank
    are left out."""
    seen: Counter = Counter()
    for m in _PY_BODY.finditer(body):
        if w := m.group(3):
            w = w.lower()
            seen[w] += 1
            yield w, seen[w], m.start(), m.end()


def _divided_words(body: str, flat: str | None, raw: bool) -> Iterator[tuple[str, str, int, int]]:
    """(word, text, start, end): words put together from two parts around a hyphen, and where."""
    for pattern, text in ((_PY_LOOSE, body), (_PY_OVER, body)) if raw else ((_PY_LOOSE, body), (_PY_TIGHT, body), (_PY_LOOSE, flat or "")):
        if "-" in text:
            for m in pattern.finditer(text):
                yield (m.group(1) + m.group(2)).lower(), text, m.start(), m.end()


def _occurrences(classes: Classes, wanted: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, words, nos, ctx = [], [], [], []

            def add(i: int, w: str, no: int, text: str, start: int, end: int) -> None:
                if wanted is None or w in wanted:
                    rows.append(i)
                    words.append(w)
                    nos.append(no)
                    ctx.append(_around(text, start, end, classes))

            for i, (field, body, flat) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 3, 4)))):
                if wanted is None or not wanted.isdisjoint(_FAST_PART.findall(body.lower().replace("_", " "))):
                    for w, no, start, end in _body_words(body):
                        add(i, w, no, body, start, end)
                if "-" in body:
                    for w, text, start, end in _divided_words(body, flat, field == "raw_text"):
                        add(i, w, -1, text, start, end)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(words, pa.string()), pa.array(nos, pa.int32()), pa.array(ctx, pa.list_(pa.int32()))], names=["field_name", "book_id", "block_id", "word", "no", "contexts"])

    return run


def genuine(clean: str, scanned: str, scale: Column, other: str, least: float = 0) -> Column:
    """Genuine uses to be expected in scanned text: as unscanned text shows them, or what misreadings of the other word can't explain."""
    return F.greatest(F.col(clean) * scale, F.col(scanned) - MOST_MISREAD * F.col(other) - least, F.lit(0.0))


def links(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, reading, prior, letters): readings of ``words`` (word) that some context could make the likelier one; ``prior`` is what speaks for the reading
    without the context; letters: the word has no sign or digit. Words of one glyph and words without a letter aren't looked at."""
    spark = words.sparkSession
    ship(spark)
    sums = counts.agg(F.sum("scanned").alias("s"), F.sum("clean").alias("c"))
    scale = sums.select(F.coalesce(F.try_divide("s", "c"), F.lit(0.0)).alias("x"))
    scale, allowed = F.lit(scale.scalar()), F.lit(scale.select(F.when(F.col("x") > 0, F.least("x", F.lit(1.0))).otherwise(F.lit(1.0))).scalar())
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    pairs = readings(words.where((letters >= 1) & (F.length("word") >= 2)), counts)
    pairs = pairs.join(counts.select(F.col("word").alias("reading"), F.col("clean").alias("cr"), F.col("scanned").alias("sr")), "reading")
    pairs = pairs.join(counts.select("word", F.col("clean").alias("cw"), F.col("scanned").alias("sw")), "word", "left").na.fill(0, ["cw", "sw"])
    gr, gw = genuine("cr", "sr", scale, "sw"), genuine("cw", "sw", scale, "sr", LEAST_OWN)
    unseen = F.when(F.col("word").rlike(r"^\p{L}+$") | (F.length("word") <= 3), UNSEEN).otherwise(UNSEEN_MIXED)
    prior = F.log(gr) - EDIT_COST * F.col("edits") - F.log(gw + unseen * allowed)
    swing = TOTAL_BOUNDS[1] - TOTAL_BOUNDS[0]
    return pairs.where((F.col("cr") > 0) | (F.col("sr") > 1)).where(gr > 0).select("word", "reading", prior.alias("prior"), F.col("word").rlike(r"^\p{L}+$").alias("letters")).where(F.col("prior") > -swing)


def _form(text: Column) -> Column:
    """Words of a text between single blanks, in lower case."""
    return F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))), F.lit(" "))


def _titles(books: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, book_titles) and (book_id, chapter, titles): the words of the titles of each book and of each of its chapters."""
    b = _formed(books.select("book_id", "title").where("title is not null")).select("book_id", _form(F.col("title")).alias("p")).where("p <> '  '")
    c = _formed(chapters.select("book_id", "number", "title").where("title is not null")).select("book_id", F.col("number").alias("chapter"), _form(F.col("title")).alias("p")).where("p <> '  '")
    return b.groupBy("book_id").agg(F.collect_set("p").alias("book_titles")), c.groupBy("book_id", "chapter").agg(F.collect_set("p").alias("titles"))


def _is_page(form: Column, page: Column) -> Column:
    """Whether a line is nothing but the page number."""
    no = page.cast("string")
    return F.coalesce(form.isin(F.concat(F.lit(" "), no, F.lit(" ")), F.concat(F.lit(" page "), no, F.lit(" ")), F.concat(F.lit(" page"), no, F.lit(" "))), F.lit(False))


def scanned(blocks: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """The texts of the scanned blocks: (field_name, book_id, block_id, page, body, flat, titled, cut). body: a raw text without running lines, a cleaned
    text as it is; flat: a cleaned text without titles and page numbers, null for raw texts; titled: it names its book or chapter; cut: it had
    running lines. Null texts are left out; repeated rows count once."""
    ocr = blocks.where("ocr").select("book_id", "block_id", "page", "raw_text", "cleaned_text").distinct()
    fields = F.explode(F.array(F.struct(F.lit("raw_text").alias("field_name"), F.col("raw_text").alias("text")), F.struct(F.lit("cleaned_text").alias("field_name"), F.col("cleaned_text").alias("text")))).alias("f")
    rows = _formed(ocr.select("book_id", "block_id", "page", fields).select("f.field_name", "book_id", "block_id", "page", "f.text").where("text is not null")).withColumn("chapter", F.regexp_extract("block_id", r"^ch([0-9]+)-", 1).try_cast("int"))
    b, c = _titles(books, chapters)
    none = F.array().cast("array<string>")
    rows = rows.join(b, "book_id", "left").join(c, ["book_id", "chapter"], "left").withColumn("titles", F.array_union(F.coalesce("book_titles", none), F.coalesce("titles", none)))

    def titled(form: Column) -> Column:
        return F.exists("titles", lambda t: F.contains(form, t))

    # The forms of lines and texts come first, as what stands inside a lambda is worked out for each of its values.
    raw = F.col("field_name") == "raw_text"
    rows = rows.withColumn("lines", F.when(raw, F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("t"), _form(x).alias("f"))))).withColumn("form", F.when(~raw, _form(F.col("text"))))
    kept = F.filter("lines", lambda x: ~(titled(x["f"]) | _is_page(x["f"], F.col("page"))))
    rows = rows.withColumn("kept", F.transform(kept, lambda x: x["t"])).withColumn("titled", ~raw & titled(F.col("form")))
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("titles", lambda t: F.replace(F.trim(t), F.lit(" "), F.lit(r"[^\p{L}\p{N}]+"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    flat = F.when(F.col("titled"), F.regexp_replace("text", pattern, " ")).otherwise(F.col("text"))
    # What is left of a running line: a page number with its signs.
    number = F.concat(F.lit(r"(?i)(?<=\s)[^\p{L}\p{N}\s]*\s?(?:page )?"), F.col("page").cast("string"), F.lit(r"\s?[^\p{L}\p{N}\s]*(?=\s|$)"))
    flat = F.when(F.col("page").isNull() | ~F.contains("text", F.col("page").cast("string")), flat).otherwise(F.regexp_replace(flat, number, " "))
    return rows.select("field_name", "book_id", "block_id", "page", F.when(raw, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("body"), F.when(~raw, flat).alias("flat"), "titled", (raw & (F.size("kept") < F.size("lines"))).alias("cut"))


def _page_count(text: Column, page: Column) -> Column:
    return F.regexp_count(text, F.concat(F.lit(r"(?<![\p{N}.,])"), page.cast("string"), F.lit(r"(?![\p{N}%]|[.,]\p{N})")))


def running(texts: DataFrame) -> DataFrame:
    """(field_name, book_id, block_id) of the texts with a running line. In a text of one line a running line is part of it: the title, or
    the number of the page where the raw body doesn't hold it as often."""
    raw = texts.where("field_name = 'raw_text'")
    body = raw.groupBy("book_id", "block_id").agg(F.min(_page_count(F.replace("body", F.lit("\n"), F.lit(" ")), F.col("page"))).alias("body_count"))
    cleaned = texts.where("field_name = 'cleaned_text'").join(body, ["book_id", "block_id"], "left")
    page = F.col("page").cast("string")
    plain = F.rlike("body", F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])page "), page, F.lit(r"(?![\p{L}\p{N}])"))) | F.rlike("body", F.concat(F.lit("(?<=^| )- "), page, F.lit(" -(?= |$)")))
    lines = F.exists(F.split("body", "\n"), lambda x: _is_page(_form(x), F.col("page")))
    counted = F.contains("body", page) & (plain | lines | (_page_count(F.col("body"), F.col("page")) > F.col("body_count")))
    hit = F.col("titled") | counted
    return raw.where("cut").select("field_name", "book_id", "block_id").union(cleaned.where(hit).select("field_name", "book_id", "block_id")).distinct()


def breaks(texts: DataFrame) -> DataFrame:
    """(field_name, book_id, block_id, l, r, far, name, joined): word parts around a hyphen that may divide a word. At line ends of raw texts,
    and before a blank or inside a word of cleaned texts; ``far``: the rest stands behind one more line or page number; ``name``: the rest
    begins with a capital after a small letter."""
    word = r"[\p{L}\p{N}|!+$@]++"
    at_end = rf"{_BREAK}[ \t]*+\n\s*+({word}(?:-{word})*+)"
    over = rf"{_BREAK}[ \t]*+\n[^\n]*+\n\s*+({word})"
    loose = rf"{_BREAK}\s++({word}(?:-{word})*+)"
    tight = rf"(?<![\p{{L}}\p{{N}}|!+$@-])({word})-({word})(?![\p{{L}}\p{{N}}|!+$@-])"

    def pairs(text: Column, pattern: str, far: bool) -> Column:
        l, r = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
        return F.zip_with(l, r, lambda a, b: F.struct(F.lower(a).alias("l"), F.lower(b).alias("r"), F.lit(far).alias("far"), (a.rlike(r"\p{Ll}$") & b.rlike(r"^\p{Lu}")).alias("name")))

    body, flat = F.col("body"), F.col("flat")
    found = F.when(F.col("field_name") == "raw_text", F.concat(pairs(body, at_end, False), pairs(body, over, True))).otherwise(F.concat(pairs(body, loose, False), pairs(flat, loose, True), pairs(body, tight, False)))
    rows = texts.where(F.contains("body", F.lit("-"))).select("field_name", "book_id", "block_id", F.explode(found).alias("p")).select("field_name", "book_id", "block_id", "p.*").distinct()
    return rows.where(F.col("l").rlike(r"\p{L}") & F.col("r").rlike(r"\p{L}")).withColumn("joined", F.concat("l", "r"))


def _head(compound: str) -> Column:
    return F.substring_index(compound, "-", 1)


class Repair:
    """Faults of scanned blocks and their repair. Corpus counts come from all blocks. Without ``vectors`` the contexts say nothing, and the counts
    alone decide."""

    def __init__(self, blocks: DataFrame, books: DataFrame, chapters: DataFrame, vectors: bool = True):
        ship(blocks.sparkSession)
        ensure_checkpoint_dir(blocks.sparkSession)
        self.counts = vocabulary(blocks).checkpoint()
        self.texts = scanned(blocks, books, chapters).checkpoint()
        self.breaks = breaks(self.texts).checkpoint()
        words = self.counts.where("scanned > 0 or cleaned > 0").select("word").union(self.breaks.select(F.explode(F.array("joined", "l", _head("r"), F.concat("l", _head("r")))).alias("word")))
        self.links = links(words.distinct().checkpoint(), self.counts).checkpoint()
        self.fixes = self._fixes(blocks, vectors).checkpoint()
        self._divided: DataFrame | None = None

    def _fixes(self, blocks: DataFrame, vectors: bool) -> DataFrame:
        """(field_name, book_id, block_id, word, no, reading): the occurrences that are misread, in their context; no: which one of this word in the
        text, -1 for words put together from two parts."""
        found = self.links.select("word").distinct()
        wanted = found.union(self.links.select("reading")).distinct()
        model = SkipGram(blocks, self.counts, wanted)
        vector = model.words.checkpoint()
        if not vectors:
            vector = vector.where("false")
        per = self.links.join(vector.select(F.col("word").alias("reading"), F.col("as_reading").alias("vector")), "reading", "left").groupBy("word").agg(F.collect_list(F.struct("reading", "prior", "letters", "vector")).alias("links"))
        per = per.join(vector.select("word", F.col("as_word").alias("own")), "word", "left").checkpoint()
        n = per.count()
        passed = frozenset(r.word for r in found.collect()) if n <= PASSED_WORDS else None
        seen = self.texts.select("field_name", "book_id", "block_id", "body", "flat").mapInArrow(_occurrences(model.classes, passed), "field_name STRING, book_id STRING, block_id STRING, word STRING, no INT, contexts ARRAY<INT>")
        # A row holds a vector for the word and each reading, some hundred bytes each.
        both = seen.join(F.broadcast(per) if n <= BROADCAST_ROWS // 64 else per, "word").select("field_name", "book_id", "block_id", "word", "no", "contexts", "own", "links")
        return both.mapInArrow(_decide(model.v), "field_name STRING, book_id STRING, block_id STRING, word STRING, no INT, reading STRING")

    def divided(self) -> DataFrame:
        """Breaks whose word has no hyphen of its own: the joined word, or its reading, is more frequent than the compound; where neither is
        known, ``_by_parts`` decides. Several results need them, so they are kept."""
        if self._divided is None:
            self._divided = self._divide().checkpoint()
        return self._divided

    def _divide(self) -> DataFrame:
        n = self.counts.select("word", "n")
        key = ["field_name", "book_id", "block_id"]
        fixed = self.fixes.where("no = -1").groupBy(*key, F.col("word").alias("joined")).agg(F.min("reading").alias("reading"))
        rows = self.breaks.withColumn("compound", F.concat_ws("-", "l", "r")).join(fixed, [*key, "joined"], "left")
        rows = rows.join(n.toDF("joined", "nj"), "joined", "left").join(n.toDF("reading", "nr"), "reading", "left").join(n.toDF("compound", "nc"), "compound", "left")
        joined = F.greatest(F.coalesce("nj", F.lit(0)), F.coalesce("nr", F.lit(0)))
        rows = rows.withColumn("nj", joined).withColumn("nc", F.coalesce("nc", F.lit(0))).checkpoint()
        known = rows.where((F.col("nj") > 0) & (F.col("nj") > F.col("nc")))
        return known.union(self._by_parts(rows)).select("field_name", "book_id", "block_id", "l", "r", "far", F.coalesce("reading", "joined").alias("whole"), "reading")

    def _by_parts(self, rows: DataFrame) -> DataFrame:
        """The rows with an unknown word and compound that are divided by their parts: at a line end of a raw text one of them is no word, part of
        a compound or misread word. The same break in the block's cleaned text is divided with it. Parts of one letter and names are compounds,
        and a break whose rest is known behind a running line is decided there."""
        key = ["field_name", "book_id", "block_id"]
        new = (F.col("nj") == 0) & (F.col("nc") == 0)
        open_ = rows.where(new & (F.col("field_name") == "raw_text") & ~F.col("far") & ~F.col("name") & (F.length("l") > 1) & (F.length(_head("r")) > 1))
        open_ = open_.join(rows.where(~new).select(*key, "l").distinct(), [*key, "l"], "left_anti").select("book_id", "block_id", "l", "r")
        parts = open_.select("book_id", "block_id", "l", "r", F.explode(F.array("l", _head("r"))).alias("part")).where(F.col("part").rlike(r"^\p{L}+$"))
        words = self.counts.where("clean + scanned > 0").select(F.col("word").alias("part")).union(self.links.where("prior > 0").select("word"))
        strange = parts.join(words, "part", "left_anti").select("book_id", "block_id", "l", "r").distinct()
        near = new & ((F.col("field_name") == "cleaned_text") | ~F.col("far"))
        return rows.where(near).join(strange, ["book_id", "block_id", "l", "r"], "left_semi").select(*rows.columns)

    def misread(self) -> DataFrame:
        """(field_name, book_id, block_id, word, no, reading) of the misread occurrences; parts of divided words are none."""
        key = ["field_name", "book_id", "block_id"]
        parts = self.divided().select(*key, F.explode(F.array("l", "r")).alias("word")).distinct()
        return self.fixes.where("no > 0").join(parts, [*key, "word"], "left_anti")

    def found(self) -> DataFrame:
        """(field_name, book_id, block_id, fault), fault 'hyphen', 'misread' or 'running'."""
        key = ["field_name", "book_id", "block_id"]
        cut = self.divided()
        parts = [
            running(self.texts).select(*key, F.lit("running").alias("fault")),
            cut.select(*key, F.lit("hyphen").alias("fault")),
            cut.where("reading is not null").select(*key, F.lit("misread").alias("fault")),
            self.misread().select(*key, F.lit("misread").alias("fault")),
        ]
        return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()

    def repaired(self) -> DataFrame:
        """(book_id, block_id, text): the raw text of every scanned block as one continuous paragraph."""
        key = ["field_name", "book_id", "block_id"]
        cut = self.divided().where("field_name = 'raw_text'").groupBy(*key).agg(F.collect_set(F.struct("l", "r", "whole")).alias("cuts"))
        wrong = self.misread().where("field_name = 'raw_text'").groupBy(*key).agg(F.collect_set(F.struct("word", "no", "reading")).alias("wrong"))
        raw = self.texts.where("field_name = 'raw_text'").join(cut, key, "left").join(wrong, key, "left")
        return raw.select("book_id", "block_id", "body", "cuts", "wrong").mapInArrow(_reflow, "book_id STRING, block_id STRING, text STRING")


def _like(found: str, reading: str) -> str:
    return reading.upper() if len(found) > 1 and found.isupper() else reading.capitalize() if found[:1].isupper() else reading


def _read(body: str, wrong: list) -> str:
    """A body with its misread occurrences in their readings."""
    read, seen = {(w["word"], w["no"]): w["reading"] for w in wrong}, Counter()

    def one(m: re.Match) -> str:
        if not m.group(3):
            return m.group()
        w = m.group().lower()
        seen[w] += 1
        return _like(m.group(), read[w, seen[w]]) if (w, seen[w]) in read else m.group()

    return _PY_BODY.sub(one, body)


def _reflow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the lines of a block: misread words in their reading, divided words whole, other hyphens at line ends without a blank."""
    head, last = re.compile(_GLYPHS), re.compile(rf"({_GLYPHS})-$")
    for b in batches:
        out = []
        for body, cuts, wrong in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            cut = {(c["l"], c["r"].split("-")[0]): c["whole"] for c in cuts or ()}
            text = ""
            for line in (x.strip() for x in (_read(body, wrong) if wrong else body).split("\n")):
                m = last.search(text)
                n = head.match(line)
                if m and n:
                    whole = cut.get((m.group(1).lower(), n.group().lower()))
                    text = text[: m.start()] + _like(m.group(1), whole) + line[n.end() :] if whole else text + line
                else:
                    text = f"{text} {line}" if text and line else text or line
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["book_id", "block_id", "text"])
