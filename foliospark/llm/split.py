"""Splitting oversized texts at natural boundaries (problem 5).

Method: agglomerative merging. A text is cut into atomic segments, at every boundary it has; adjacent pairs of segments stand in a heap by
the strength of the boundary between them; the weakest is merged first, as long as the two together with the overlap fit the limit. What
is left are the pieces, parted at the strongest boundaries that the limit allows. Texts within their limit never leave the JVM.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship

# Boundaries from strong to weak: the place behind the match is where a text may be cut. Strength 0 is a cut inside a word.
BOUNDARIES = [
    (7, re.compile(r"\n+(?=#{1,6} )")),
    (6, re.compile(r"\n[ \t]*\n+")),
    (5, re.compile(r"\n(?=[ \t]*(?:[-*+•] |\d+[.)] |\|))")),
    (4, re.compile(r"\n+|(?<=</tr>)|(?<=</li>)|(?<=</p>)|<br\s*/?>", re.I)),
    (3, re.compile(r"[.!?…][\"'”’)\]]*[ \t]+(?=[^a-z\s])|[。！？]")),
    (2, re.compile(r"[,;:–—][ \t]+|[、，；]")),
    (1, re.compile(r"\s+")),
]
_KEPT = re.compile(r"^(```+|~~~+).*?^\1|\$\$.*?\$\$", re.S | re.M)


def atoms(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments, none longer than ``limit``, and the strength of the boundary at each. Lines inside code and display
    formulas part weaker than sentences do."""
    strength: dict[int, int] = {}
    for s, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            strength[m.end()] = s
    for m in _KEPT.finditer(text):
        for p in [p for p in range(m.start() + 1, m.end()) if strength.get(p, 0) > 2]:
            strength[p] = 2
    strength.pop(0, None)
    strength[len(text)] = 9
    ends, at = [], 0
    for p in sorted(strength):
        while p - at > limit:
            at += limit
            ends.append(at)
        if p > at:
            ends.append(p)
            at = p
    return ends, [strength.get(e, 0) for e in ends]


def split(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces in code points. Each is at most ``max_chars`` long and, but for the first, begins ``overlap`` before the
    end of the one before it. An overlap of the limit or more leaves no room and is cut to one less than the limit. A text within the limit is
    one piece."""
    if len(text) <= max_chars:
        return [(0, len(text))]
    max_chars = max(1, max_chars)
    overlap = max(0, min(overlap, max_chars - 1))
    ends, strength = atoms(text, max_chars - overlap)
    n = len(ends)
    start = [0, *ends[:-1]]
    end = list(ends)
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strength[i], end[i + 1] - start[i], i, end[i], end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, cut, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or end[i] != cut or end[j] != stop:
            continue
        if stop - start[i] + (overlap if start[i] else 0) > max_chars:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        k = after[j]
        if k >= 0:
            before[k] = i
            heapq.heappush(heap, (_strength(strength, ends, stop), end[k] - start[i], i, stop, end[k]))
        h = before[i]
        if h >= 0:
            heapq.heappush(heap, (_strength(strength, ends, start[i]), stop - start[h], h, end[h], stop))
    return [(max(0, start[i] - overlap) if start[i] else 0, end[i]) for i in range(n) if alive[i]]


def _strength(strength: list[int], ends: list[int], at: int) -> int:
    return strength[bisect_left(ends, at)]


def _split_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_columns - 3
        texts, limits, overlaps = (b.column(n + i).to_pylist() for i in range(3))
        rows, nos, starts, ends, pieces = [], [], [], [], []
        for r, (t, m, o) in enumerate(zip(texts, limits, overlaps)):
            for no, (s, e) in enumerate(split(t, m, o or 0), 1):
                rows.append(r)
                nos.append(no)
                starts.append(s)
                ends.append(e)
                pieces.append(t[s:e])
        keys = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(n)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(nos, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(pieces, pa.string())], names=[*b.schema.names[:n], "piece_no", "start", "end", "piece"])


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """The pieces of the rows whose text exceeds its limit: ``keys``, piece_no (from 1), start, end (code points, end excluded), piece.
    Null texts and null limits exceed nothing."""
    ship(df.sparkSession)
    over = df.where(F.length(text) > F.col(limit)).select(*keys, F.col(text).alias("__t"), F.col(limit).cast("int").alias("__m"), F.col(overlap).cast("int").alias("__o"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in over.schema.fields[:-3])
    return over.mapInArrow(_split_partition, f"{schema}, piece_no INT, start INT, end INT, piece STRING")


def _sources(out_items: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    md = out_items.select(F.lit("md").alias("field_name"), "book_id", "block_id", F.col("md").alias("text"), "kind")
    rows = md.union(blocks.select(F.lit("markdown"), "book_id", "block_id", "markdown", "block_type"))
    smallest = limits.groupBy("kind").agg(F.min("max_chars").alias("max_chars"), F.min_by("overlap_chars", "max_chars").alias("overlap_chars"))
    return rows.join(smallest, "kind", "left")


_KEYS = ["field_name", "book_id", "block_id"]


def found(out_items: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(field_name, book_id, block_id) of the texts that have to be cut. Repeated rows count once; kinds without a limit are never cut."""
    rows = _sources(out_items, blocks, limits)
    return split_oversized(rows, _KEYS, "text", "max_chars", "overlap_chars").where("piece_no > 1").select(*_KEYS).distinct()


def pieces(out_items: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(field_name, book_id, block_id, piece_no, start, end, piece): every text in pieces within its limit; most texts are one piece. Null
    texts have none; repeated rows of one key and text count once; several texts of one key each have their pieces."""
    rows = _sources(out_items, blocks, limits).where("text is not null")
    whole = rows.where("max_chars is null or length(text) <= max_chars").select(*_KEYS, F.lit(1).alias("piece_no"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("piece"))
    return whole.union(split_oversized(rows, _KEYS, "text", "max_chars", "overlap_chars")).distinct()
