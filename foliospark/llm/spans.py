"""Long exact spans shared between records (problem 9).

Method: Rabin-Karp hashes of every fixed-length window of tokens, counted in Spark; repeated windows merge into maximal intervals. The
tokens are code points, since the problem asks for runs of code points. The window is shorter than the wanted run (``WINDOW`` of
``min_chars``), and of the windows that start in any ``min_chars - WINDOW + 1`` consecutive places only the one of least hash is shuffled
(winnowing). That loses nothing: a common run of ``min_chars`` holds all of those windows in either text, so both texts choose the same.

1. Every distinct text is a class (the first 128 bits of its SHA-256), so that copies are never compared with each other.
2. The texts are hashed once; each class keeps the chosen windows as two arrays. Windows are counted by hash; hashes met in one class only
   are dropped. The others are a small materialised table.
3. Hashes of up to ``HOT`` rows give candidate pairs of classes with their anchor places; the two texts are compared around the
   anchors, which gives the maximal common runs.
4. Hashes of more rows (a notice in a third of all documents) aren't paired on a short window: all windows of ``min_chars`` code points
   over those anchors are hashed and counted, so that the work stays linear in the text until the pairs themselves are asked for. Here no
   texts are compared, so each window has a second hash, modulo two primes at bases drawn anew in each run: whatever the texts, two different
   windows of one first hash agree in it with a chance below 1e-13. Windows that the same classes hold are one group, and a large group
   is split over many tasks before its classes are paired.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import BROADCAST_ROWS, ensure_checkpoint_dir, ship

MIN_CHARS = 240
WINDOW = 120
#: Rows of one window hash above which pairs are made of whole runs only.
HOT = 200
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class RollingHash:
    """Rabin-Karp hashes modulo 2**64, with a final mix, of all windows of a run of code points."""

    def __init__(self, longest: int):
        self.up, self.down = _powers(_BASE, longest), _powers(pow(_BASE, -1, 1 << 64), longest)

    def windows(self, codes: np.ndarray, width: int) -> np.ndarray:
        n = len(codes)
        if n < width:
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[width:] - total[:-width]) * self.down[: n - width + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


#: Two primes below 2**31.
_PRIMES = (2147483629, 2147483587)


def _powers_mod(base: int, n: int, p: int) -> np.ndarray:
    """1, base, base**2 and so on modulo p, doubled in length at each step."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


def prime_windows(codes: np.ndarray, width: int, bases: tuple[int, int]) -> np.ndarray:
    """62 bits of each window: its value as a polynomial at each base, modulo each prime."""
    out = np.zeros(max(0, len(codes) - width + 1), np.int64)
    for base, p in zip(bases, _PRIMES):
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum((codes.astype(np.int64) + 1) * _powers_mod(base, len(codes), p) % p, out=total[1:])
        h = (total[width:] - total[:-width]) % p * _powers_mod(pow(base, -1, p), len(out), p) % p
        out = (out << 31) | h
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def winnow(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash (the leftmost, if equal in 44 bits) of each ``width`` consecutive ones that begin at a valid place."""
    n = len(hashes)
    if n < width or not valid.any():
        return np.zeros(0, np.int64)
    low = np.uint64(_CHUNK - 1)
    keys = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    rows = keys.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(valid[: n - width + 1])
    least = np.minimum(tail[starts], head[starts + width - 1])
    at = (least & low).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _chunks(classes: list[int], texts: list[str], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
    """Runs of texts of at most _CHUNK code points: class, first place in the run, place in the text, all joined. Long texts are cut with
    an overlap."""
    cls, base, off, parts, size = [], [], [], [], 0
    for c, t in zip(classes, texts):
        for at in range(0, max(1, len(t) - overlap), _CHUNK - overlap):
            piece = t[at : at + _CHUNK]
            if size + len(piece) > _CHUNK and parts:
                yield np.array(cls, np.int64), np.array(base, np.int64), np.array(off, np.int64), "".join(parts)
                cls, base, off, parts, size = [], [], [], [], 0
            cls.append(c)
            base.append(size)
            off.append(at)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield np.array(cls, np.int64), np.array(base, np.int64), np.array(off, np.int64), "".join(parts)


def _scan(min_chars: int, window: int):
    width = min_chars - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash(_CHUNK)
        for batch in batches:
            n, found = batch.num_rows, []
            for row, base, off, text in _chunks(list(range(n)), batch.column(1).to_pylist(), min_chars - 1):
                codes = _codes(text)
                h = roll.windows(codes, window)
                valid = np.zeros(len(codes) + 1, np.int8)  # places where a whole run of min_chars of one text begins
                ends = np.append(base[1:], len(codes))
                fits = ends - base >= min_chars
                np.add.at(valid, base[fits], 1)
                np.add.at(valid, ends[fits] - min_chars + 1, -1)
                at = winnow(h, np.cumsum(valid)[:-1][: len(h)] > 0, width)
                which = np.searchsorted(base, at, side="right") - 1
                found.append((row[which], h[at].view(np.int64), (at - base[which] + off[which]).astype(np.int32)))
            rows, fps, places = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            cuts = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(fps)), pa.ListArray.from_arrays(cuts, pa.array(places.astype(np.int32)))], names=["cls", "fps", "places"])

    return run


def _run_windows(min_chars: int, window: int, bases: tuple[int, int]):
    """Both hashes of all windows of min_chars code points that cover one of the given anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text, anchors in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes = _codes(text)
                h = RollingHash(len(codes)).windows(codes, min_chars)
                want = np.zeros(len(h) + 1, np.int64)
                for p in anchors:
                    want[max(0, p + window - min_chars)] += 1
                    want[min(p, len(h) - 1) + 1] -= 1
                at = np.flatnonzero(np.cumsum(want)[:-1] > 0)
                second = prime_windows(codes, min_chars, bases)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(second[at]), pa.array([cls] * len(at), pa.binary()), pa.array(at.astype(np.int32))], names=["wh", "wv", "cls", "start"])

    return run


def _common_prefix(a: str, i: int, b: str, j: int) -> int:
    lo, step = 0, 32
    n = min(len(a) - i, len(b) - j)
    while lo < n:
        step = min(step, n - lo)
        if a[i + lo : i + lo + step] == b[j + lo : j + lo + step]:
            lo += step
            step *= 2
        elif step == 1:
            break
        else:
            n, step = lo + step, step // 2
    return lo


def _runs(min_chars: int, window: int):
    """The maximal common runs of two texts that cover one of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ca, cb, anchors, a, b in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ra, rb = a[::-1], b[::-1]
                seen: dict[int, int] = {}
                for pa_, pb in sorted((x["pa"], x["pb"]) for x in anchors):
                    if pa_ < seen.get(pa_ - pb, -1):
                        continue
                    if a[pa_ : pa_ + window] != b[pb : pb + window]:
                        continue
                    left = _common_prefix(ra, len(a) - pa_, rb, len(b) - pb)
                    right = _common_prefix(a, pa_, b, pb)
                    seen[pa_ - pb] = pa_ + right
                    if left + right >= min_chars:
                        out.append((ca, cb, pa_ - left, pb - left, left + right))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()))], names=["cls_a", "cls_b", "start_a", "start_b", "length"])

    return run


#: Members of a group that one task pairs with all of the group.
_SPLIT = 256


def pairs_within(members: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b), a < b: the pairs of members of each group. ``members``: the group, its number of members ``n``, and the member. A large group is split: each
    of its parts meets the whole group in a task of its own."""
    parts = F.ceil(F.col("n") / _SPLIT).cast("int")
    a = members.select(F.col(group).alias("ga"), F.pmod(F.xxhash64(member), parts).cast("int").alias("part"), F.col(member).alias("a"))
    b = members.select(F.col(group).alias("gb"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_b"), F.col(member).alias("b"))
    return a.join(b, (F.col("ga") == F.col("gb")) & (F.col("part") == F.col("part_b")) & (F.col("a") < F.col("b"))).select("a", "b")


class SharedSpans:
    """Spans of at least ``min_chars`` code points that stand in more than one record, character for character.

    Null texts and texts shorter than ``min_chars`` share nothing. Copies of one text are one class. A span that is repeated only inside
    one record isn't shared. Repeated rows of one id count once. Columns other than ``id_col`` and ``text_col`` are not read.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, window: int = WINDOW, hot: int = HOT):
        if not 0 < window < min_chars:
            raise ValueError("the window must be shorter than the span")
        spark = df.sparkSession
        ship(spark)
        ensure_checkpoint_dir(spark)
        self.min_chars = min_chars
        text = F.col(text_col)
        cls = F.unhex(F.left(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(32)))
        long = df.where(F.length(text) >= min_chars).select(F.col(id_col).alias("id"), cls.alias("cls"), text.alias("text"))
        self.members = long.select("cls", "id", F.length("text").alias("n"))
        self._texts = long.select("cls", "text")
        scan = self._texts.mapInArrow(_scan(min_chars, window), "cls BINARY, fps ARRAY<LONG>, places ARRAY<INT>").checkpoint()
        counts = scan.select("cls", F.explode("fps").alias("fp")).groupBy("fp").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("n"))
        repeated = counts.where("a <> b").select("fp", (F.col("n") > hot).alias("hot")).checkpoint()
        n, n_hot = repeated.agg(F.count("*"), F.count_if("hot")).first()
        chosen = scan.select("cls", F.explode(F.arrays_zip("fps", "places")).alias("w")).select("cls", F.col("w.fps").alias("fp"), F.col("w.places").alias("pos"))
        rows = chosen.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, "fp").distinct().checkpoint()
        self._cold = self._cold_runs(rows.where("not hot"), min_chars, window)
        self._windows = self._hot_windows(rows.where("hot"), min_chars, window) if n_hot else None

    def _text_of(self, classes: DataFrame) -> DataFrame:
        return self._texts.join(classes, "cls", "left_semi").groupBy("cls").agg(F.first("text").alias("text"))

    def _cold_runs(self, rows: DataFrame, min_chars: int, window: int) -> DataFrame:
        a = rows.select("fp", F.col("cls").alias("cls_a"), F.col("pos").alias("pa"))
        b = rows.select("fp", F.col("cls").alias("cls_b"), F.col("pos").alias("pb"))
        pairs = a.join(b, (a.fp == b.fp) & (a.cls_a < b.cls_b)).groupBy("cls_a", "cls_b").agg(F.collect_set(F.struct("pa", "pb")).alias("anchors"))
        texts = self._text_of(rows.select("cls").distinct())
        both = pairs.join(texts.toDF("cls_a", "text_a"), "cls_a").join(texts.toDF("cls_b", "text_b"), "cls_b")
        return both.select("cls_a", "cls_b", "anchors", "text_a", "text_b").mapInArrow(_runs(min_chars, window), "cls_a BINARY, cls_b BINARY, start_a INT, start_b INT, length INT")

    def _hot_windows(self, rows: DataFrame, min_chars: int, window: int) -> DataFrame:
        anchors = rows.groupBy("cls").agg(F.collect_set("pos").alias("anchors"))
        bases = tuple(secrets.randbelow(p - 3) + 2 for p in _PRIMES)
        found = self._text_of(anchors.select("cls")).join(anchors, "cls").mapInArrow(_run_windows(min_chars, window, bases), "wh LONG, wv LONG, cls BINARY, start INT")
        found = found.checkpoint()
        shared = found.groupBy("wh", "wv").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("wh", "wv")
        return found.join(shared, ["wh", "wv"], "left_semi")

    def _hot_groups(self) -> DataFrame:
        """(g, cls): the classes under each hot window, windows under the same classes once. g stands for a set of classes: their number and
        two sums of hashes."""
        w = self._windows.select("wh", "wv", "cls").distinct()
        wide = [F.sum(F.xxhash64(F.lit(i), "cls").cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
        sets = w.groupBy("wh", "wv").agg(F.count("*").alias("n"), *wide)
        first = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("wh", "wv")).alias("g")).select("g", "n")
        return w.join(first.select(F.col("g.wh").alias("wh"), F.col("g.wv").alias("wv"), "n"), ["wh", "wv"]).select(F.struct("wh", "wv").alias("g"), "n", "cls")

    def class_pairs(self) -> DataFrame:
        """(cls_a, cls_b): different texts with a common span."""
        pairs = self._cold.select("cls_a", "cls_b")
        if self._windows is not None:
            pairs = pairs.union(pairs_within(self._hot_groups(), "g", "cls").toDF("cls_a", "cls_b"))
        return pairs.distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: all pairs of records with a common span, copies included."""
        m = self.members.select("cls", "id").distinct()
        a, b = m.toDF("cls_a", "doc_x"), m.toDF("cls_b", "doc_y")
        across = self.class_pairs().join(a, "cls_a").join(b, "cls_b").select(F.least("doc_x", "doc_y").alias("doc_a"), F.greatest("doc_x", "doc_y").alias("doc_b"))
        sizes = m.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
        return across.union(pairs_within(m.join(sizes, "cls"), "cls", "id").toDF("doc_a", "doc_b"))

    def intervals(self) -> DataFrame:
        """(cls, start, end): maximal intervals of each class that stand in another class, code points from 0, end excluded."""
        c = self._cold
        spans = c.select(F.col("cls_a").alias("cls"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("end"))
        spans = spans.union(c.select("cls_b", "start_b", F.col("start_b") + F.col("length")))
        if self._windows is not None:
            spans = spans.union(self._windows.select("cls", "start", F.col("start") + F.lit(self.min_chars)))
        w = Window.partitionBy("cls").orderBy("start", "end")
        before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = spans.distinct().withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
        return marked.withColumn("k", F.sum("new").over(w)).groupBy("cls", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")

    def report(self) -> DataFrame:
        """(id, class_id, copies, n_chars, shared_chars, shared_ratio): one row for each record that shares a span. class_id is the least
        id with the same text; a text with copies is shared as a whole."""
        m = self.members.distinct()
        cls = m.groupBy("cls").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
        inside = self.intervals().groupBy("cls").agg(F.sum(F.col("end") - F.col("start")).alias("inside"))
        known = cls.join(inside, "cls", "left").where("copies > 1 or inside is not null")
        shared = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.col("inside")).cast("long")
        return m.join(known, "cls").select(
            "id", "class_id", "copies", F.col("n").cast("long").alias("n_chars"), shared.alias("shared_chars"), F.round(shared / F.col("n"), 4).alias("shared_ratio")
        )
