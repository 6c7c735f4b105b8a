"""Byte-level BPE encoding of a corpus (problem 7).

The vocabulary and the merge ranks come from a public tokenizer file; they are read on each executor and never trained here.

Method: pair occurrence index. Texts are cut into pre-tokens; the distinct new pre-tokens of a partition are laid out as one linked
array of symbols; every adjacent pair is mapped to all its positions in the partition; active ranks are applied in ascending order from
a heap, and each merge updates the lists of the pairs to its left and right. Every text is then gathered from the encoded pre-tokens.
Work is linear in the text, whatever the length of a pre-token, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.session import ship

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

# White space as the public pre-tokenizer understands it, and its pattern (contractions, letters, numbers, others, blanks).
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _ranges(kind: str) -> str:
    """Code points below 65536 of a general category, as the inside of a character class."""
    out, first = [], -1
    for c in range(0x10001):
        inside = c < 0x10000 and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == kind
        if inside and first < 0:
            first = c
        elif not inside and first >= 0:
            out.append(f"{chr(first)}-{chr(c - 1)}")
            first = -1
    return "".join(out)


def _plane_pattern() -> re.Pattern:
    """The same pattern for texts without code points above 65535; the standard library's engine is twice as fast on it."""
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


#: Characters gathered before a batch of results leaves a worker; distinct pre-tokens kept by a worker before it starts afresh.
BATCH_CHARS = 2_000_000
CACHE_WORDS = 1_000_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> str:
    """Place of a tokenizer file: in ``folder``, or where the installed ``public_tokenizers`` package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next free code point from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(free)) for b in range(256)]


class PairIndexEncoder:
    """Encodes sets of pre-tokens by the occurrences of their symbol pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, chars = model["vocab"], _byte_chars()
        self.byte_id = [vocab[c] for c in chars]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])

    def encode(self, words: list[str]) -> list[list[int]]:
        merge, byte_id = self.merge, self.byte_id
        sym: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        starts: list[int] = []
        for w in words:
            s = len(sym)
            starts.append(s)
            sym += [byte_id[b] for b in w.encode("utf-8", "replace")]
            e = len(sym)
            nxt += [*range(s + 1, e), -1]
            prv += [-1, *range(s, e - 1)]
        index: dict[int, list[int]] = {}
        made: dict[int, int] = {}
        for p, q in enumerate(nxt):
            if q >= 0 and (m := merge.get(sym[p] << 20 | sym[q])):
                if m[0] in index:
                    index[m[0]].append(p)
                else:
                    index[m[0]] = [p]
                    made[m[0]] = m[1]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            new = made[rank]
            for p in sorted(index.pop(rank)):
                q = nxt[p]
                if sym[p] < 0 or q < 0 or merge.get(sym[p] << 20 | sym[q], (-1,))[0] != rank:
                    continue
                sym[p], sym[q] = new, -1
                after, before = nxt[q], prv[p]
                nxt[p] = after
                if after >= 0:
                    prv[after] = p
                for left, right in ((p, after), (before, p)):
                    if left >= 0 and right >= 0 and (m := merge.get(sym[left] << 20 | sym[right])):
                        if m[0] in index:
                            index[m[0]].append(left)
                        else:
                            index[m[0]] = [left]
                            made[m[0]] = m[1]
                            heapq.heappush(heap, m[0])
        out = []
        for s in starts:
            ids = []
            while s >= 0:
                ids.append(sym[s])
                s = nxt[s]
            out.append(ids)
        return out


class _Codes(dict):
    """Numbers pre-tokens in the order in which they come."""

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


class CorpusEncoder:
    """Encodes texts batch by batch; pre-tokens met before are not encoded again."""

    def __init__(self, path: str):
        self.bpe = PairIndexEncoder(path)
        self.plane, self.full = _plane_pattern(), regex.compile(_PATTERN)
        self._reset()

    def _reset(self) -> None:
        self.codes, self.done = _Codes(), 0
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _word_codes(self, text: str) -> np.ndarray:
        pattern = self.plane if text.isascii() or max(text) <= "\uffff" else self.full
        get = self.codes.__getitem__
        if len(text) > BATCH_CHARS:
            return np.fromiter((get(m.group()) for m in pattern.finditer(text)), np.int32)
        words = pattern.findall(text)
        return np.fromiter(map(get, words), np.int32, len(words))

    def _encode_new(self) -> None:
        if len(self.codes) > self.done:
            new = list(self.codes)[self.done :] if self.done else list(self.codes)
            ids = self.bpe.encode(new)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat, self.done = np.concatenate([self.size, size]), np.concatenate([self.flat, flat]), len(self.codes)

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, behind the last, number of ids of each text, all word codes as ids) for runs of about BATCH_CHARS."""
        i = 0
        while i < len(texts):
            if len(self.codes) > CACHE_WORDS:
                self._reset()
            parts, chars, j = [], 0, i
            while j < len(texts) and (j == i or chars < BATCH_CHARS):
                t = texts[j] or ""
                parts.append(self._word_codes(t))
                chars += len(t)
                j += 1
            self._encode_new()
            words = np.concatenate(parts)
            size = self.size[words]
            ends = np.concatenate([[0], np.cumsum(size)])
            bounds = np.cumsum([0, *map(len, parts)])
            counts = np.diff(ends[bounds])
            yield i, j, counts, words
            i = j

    def ids(self, words: np.ndarray) -> np.ndarray:
        size = self.size[words]
        total = int(size.sum())
        return self.flat[np.repeat(self.start[words] - (np.cumsum(size) - size), size) + np.arange(total)]


def _encode_partition(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = CorpusEncoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for i, j, counts, words in enc.batches(texts):
                keys = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    out = pa.ListArray.from_arrays(offsets, pa.array(enc.ids(words), pa.int32()))
                else:
                    out = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays([*keys, out], names=[*batch.schema.names[:-1], "ids" if with_ids else "n_tokens"])

    return run


def encode(df: DataFrame, keys: list[str], text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Ids of each text, one row for every row of ``df``: the columns ``keys`` and ``ids ARRAY<INT>``.

    A null or empty text gives an empty list. Special tokens are neither added nor recognised: their strings are ordinary text.
    Columns other than ``keys`` and ``text`` are not read. Repeated rows stay repeated. Not changed: lone surrogates count as U+003F.
    """
    ship(df.sparkSession)
    src = df.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    return src.mapInArrow(_encode_partition(tokenizer or tokenizer_path(), True), schema)


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Number of tokens of each text: the columns ``keys`` and ``n_tokens LONG``; 0 for a null or empty text."""
    ship(df.sparkSession)
    src = df.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType(), False)])
    return src.mapInArrow(_encode_partition(tokenizer or tokenizer_path(), False), schema)
