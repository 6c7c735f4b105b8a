"""Mixing sources to target weights (problem 8).

Method: Poisson replication. Every document draws its count from a Poisson distribution, cut off at the allowed repeats: the distribution is
inverted at a number in [0, 1) that comes from the hash of the document alone. Each document is exploded by its count, and the copies are
shuffled by another hash, texts and all.

The rate of a source is the one at which the counts drawn add up to its wanted tokens. It lies near wanted over own tokens, and is found on the
tokens of the source by bins of those numbers, so shares hold within about a document or a bin instead of the spread of independent draws.
A document keeps its number whatever others come or go; the rate moves a little, and with it the few counts that stand next to a step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.tokens import count_tokens
from foliospark.session import ensure_checkpoint_dir, ship

#: Bins of the documents' numbers; a source's tokens are known to about a bin.
BINS = 1 << 14


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson variable of this rate, cut off at ``cap``."""
    p = below = math.exp(-rate)
    mean = 0.0
    for k in range(1, cap):
        p *= rate / k
        mean += k * p
        below += p
    return mean + cap * max(0.0, 1.0 - below)


def solve_rate(mean: float, cap: int) -> float:
    """The Poisson rate whose mean, cut off at ``cap``, is ``mean``; infinite where every document is taken ``cap`` times."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean:
        hi *= 2
        if hi > 600:
            return math.inf
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return (lo + hi) / 2


def thresholds(rate: float, cap: int) -> list[float]:
    """Where the count of the inverted distribution steps up by one."""
    if math.isinf(rate):
        return [0.0] * cap
    out, p, below = [], math.exp(-rate), 0.0
    for k in range(cap):
        below += p
        out.append(below)
        p *= rate / (k + 1)
    return out


def drawn(above: np.ndarray, steps: list[float]) -> float:
    """Tokens drawn with these steps: each is passed by the documents whose number isn't below it. ``above``: the tokens from each bin's beginning on, with
    0 behind the last; within a bin they lie evenly."""
    at = np.clip(np.array(steps), 0.0, 1.0) * BINS
    return float(np.interp(at, np.arange(BINS + 1), above).sum())


def calibrate(above: np.ndarray, wanted: float, cap: int) -> list[float]:
    """Steps of the Poisson distribution, cut off at ``cap``, whose draws add up to the wanted tokens."""
    own = float(above[0])
    if own <= 0 or wanted <= 0 or cap <= 0:
        return []
    if wanted >= own * cap:
        return [0.0] * cap
    # The rate of the mean lies near; the tokens at hand move it.
    lo, hi = 0.0, min(solve_rate(wanted / own, cap) * 1.5 + 0.001, 600.0)
    while drawn(above, thresholds(hi, cap)) < wanted and hi < 600:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(above, thresholds(mid, cap)) < wanted else (lo, mid)
    return thresholds(hi, cap)


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        steps = []
        for w, c, bins in zip(b["wanted"], b["max_repeats"], b["bins"]):
            tokens = np.zeros(BINS + 1)
            for x in [] if bins is None else bins:
                tokens[x["bin"]] = x["n"]
            steps.append(calibrate(tokens[::-1].cumsum()[::-1], w, int(c)))
        yield b.drop(columns="bins").assign(steps=steps)


class Mixture:
    """Documents drawn so that each source of ``targets`` (source, target_share, max_repeats) has its share of all tokens drawn.

    total: 'feasible', the largest total at which every source that has tokens keeps its share within its repeats; or a number of tokens,
    of which sources whose repeats don't suffice give what they have. Shares of sources without tokens can't be met; the others keep
    their proportions. Documents of other or no sources and null targets are left out; a null, empty or blank text counts the tokens it has,
    and documents without a token are never drawn. Several targets of one source: the largest share and its repeats hold.
    Targets are one row a source and never grow with the documents; the bins of a source are at most BINS.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: str | float = "feasible", seed: int = 8, tokenizer: str | None = None):
        spark = documents.sparkSession
        ship(spark)
        ensure_checkpoint_dir(spark)
        targets = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("t")).select("source", "t.*")
        self._known = documents.select("doc_id", "source", "text").join(F.broadcast(targets.select("source")), "source", "left_semi")
        self._seed = seed
        self.sizes = count_tokens(self._known, ["doc_id", "source"], tokenizer=tokenizer).checkpoint()
        own = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("own"), F.count("*").alias("documents"))
        per = targets.join(own, "source", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
        everything = Window.partitionBy()  # over one row a source
        met = F.sum(F.when(F.col("own") > 0, F.col("target_share"))).over(everything)
        feasible = F.min(F.when(F.col("own") > 0, F.col("own") * F.col("max_repeats") / F.col("target_share"))).over(everything) * met
        size = feasible if total == "feasible" else F.lit(float(total))
        wanted = F.when(F.col("own") > 0, size * F.col("target_share") / met).otherwise(F.lit(0.0))
        bins = self.sizes.where("n_tokens > 0").groupBy("source", F.floor(self._number() * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n"))
        bins = bins.groupBy("source").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
        per = per.select("source", "target_share", "max_repeats", "own", "documents", wanted.alias("wanted")).join(bins, "source", "left")
        self.rates = per.mapInPandas(_steps, "source STRING, target_share DOUBLE, max_repeats INT, own LONG, documents LONG, wanted DOUBLE, steps ARRAY<DOUBLE>").checkpoint()

    def _number(self) -> Column:
        """The number in [0, 1) at which a document's distribution is inverted."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self._seed), "doc_id", "source"), 11) / F.lit(float(1 << 53))

    def _drawn(self, rows: DataFrame) -> DataFrame:
        steps = F.broadcast(self.rates.select("source", "steps"))
        number = self._number()
        drawn = rows.withColumn("__u", number).join(steps, "source").withColumn("repeats", F.size(F.filter("steps", lambda s: s <= F.col("__u"))))
        return drawn.where("repeats > 0").drop("__u", "steps")

    def counts(self) -> DataFrame:
        """(doc_id, source, n_tokens, repeats) of the documents drawn at least once."""
        return self._drawn(self.sizes.where("n_tokens > 0")).select("doc_id", "source", "n_tokens", "repeats")

    def copies(self) -> DataFrame:
        """(doc_id, source, copy_no, repeats, shuffle_key, text): one row for each copy, in the order of a hash within partitions drawn by it. The draw needs
        no more than the document, so texts are read again and joined with nothing. A text without a character has no token."""
        rows = self._drawn(self._known.where("text is not null and text <> ''")).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        key = F.xxhash64(F.lit(self._seed + 1), "doc_id", "copy_no")
        rows = rows.select("doc_id", "source", "copy_no", "repeats", key.alias("shuffle_key"), "text")
        return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, error, documents, chosen, copies, tokens, most_repeats, max_repeats) for each source of the targets; error:
        what the actual share is above the target."""
        c = self.counts().groupBy("source").agg(F.count("*").alias("chosen"), F.sum("repeats").alias("copies"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("repeats").alias("most_repeats"))
        r = self.rates.select("source", "target_share", "documents", "max_repeats").join(c, "source", "left").na.fill(0, ["chosen", "copies", "tokens", "most_repeats"])
        share = F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0))
        return r.select("source", "target_share", F.round(share, 6).alias("actual_share"), F.round(share - F.col("target_share"), 6).alias("error"), "documents", "chosen", "copies", "tokens", "most_repeats", "max_repeats")
