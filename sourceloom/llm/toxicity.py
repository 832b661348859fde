"""Toxicity: non-negative positive-unlabelled learning of a linear classifier in numpy.

Confirmed toxic texts are the positives; a draw of all texts, whose labels are not looked at, is
the unlabelled set. The risk ``p * R_pos(1) + max(0, R_unl(0) - p * R_pos(0))`` corrects the
unlabelled part by the class prior ``p`` and never lets it fall below zero (where it does, the
step goes the other way, as in the published method). Losses are logistic, so scores are
posteriors. Features are the presence of hashed lower-case words and of their first 4 and 5
letters (a stem, so that inflected insults share weight); features seen in few texts of the
sample carry none. A first descent with a strong L1 step chooses few features, a second one fits
those alone with a weak one, so long texts gather no noise and weights are not shrunk.

Cases: null and empty texts score the intercept; texts are read whole; repeated rows score
alike; without a confirmed toxic text every score is 0; columns named like the outputs are
replaced, others stay.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import CACHE_WORDS, bounded_ids, fold, sampled_texts, ship, sigmoid, table, without

TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    max_positives: int = 2000  # bounds of the two fitted samples
    max_unlabelled: int = 4000
    max_chars: int = 200_000
    min_texts: int = 8  # texts of the sample that must have a word
    steps: tuple[int, int] = (120, 400)  # of the choosing and of the fitting descent
    rate: float = 0.1
    l1: tuple[float, float] = (2e-3, 1e-6)
    beta: float = 0.0


class Stems(dict):
    """word -> hashes of the word and its two prefixes, emptied when full."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        raw = [f"^{word}$", f"^{word[:4]}", f"^{word[:5]}"]
        found = self[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in raw)
        return found


STEMS = Stems()


def presence(text: str | None, bits: int) -> np.ndarray:
    """Hashed distinct features of a whole text."""
    words = set(TOKEN.findall((text or "").lower()))
    hashes = np.fromiter(chain.from_iterable(map(STEMS.__getitem__, words)), np.int64, 3 * len(words))
    return np.unique(hashes & (2**bits - 1))


def descend(
    at: np.ndarray, row: np.ndarray, is_pos: np.ndarray, width: int, prior: float, l1: float, steps: int, s: Settings
) -> tuple[np.ndarray, float]:
    """Adam with proximal L1 steps on the non-negative risk; entry ``at[i]`` is present in row ``row[i]``."""
    n_pos, n_rows = int(is_pos.sum()), len(is_pos)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[at], minlength=n_rows)
        p = sigmoid(z)
        softplus = np.logaddexp(0.0, z)  # loss of label 0
        negative = softplus[~is_pos].mean() - prior * softplus[is_pos].mean()
        slope = np.where(is_pos, -prior * p / n_pos, p / (n_rows - n_pos))
        if negative < -s.beta:
            slope = -slope  # only the negative part, uphill
        else:
            slope[is_pos] += prior * (p[is_pos] - 1.0) / n_pos
        g = np.append(np.bincount(at, weights=slope[row], minlength=width), slope.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        rate = s.rate / np.sqrt(1 + step / 50)
        denominator = np.sqrt(v / (1 - 0.999**step)) + 1e-5
        move = rate * (m / (1 - 0.9**step)) / denominator
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / denominator[:-1], 0.0)
        b -= move[-1]
    return w, float(b)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights by hashed feature, and intercept."""
    weights = np.zeros(2**s.bits, np.float32)
    if not pos or not unl or prior <= 0:
        return weights, -35.0
    prior = min(prior, 0.99)
    rows = pos + unl
    hashed = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    is_pos = np.arange(len(rows)) < len(pos)
    used = np.flatnonzero(np.bincount(hashed, minlength=2**s.bits) >= s.min_texts)
    bias = 0.0
    for l1, steps in zip(s.l1, s.steps, strict=True):
        place = np.full(2**s.bits, -1, np.int32)
        place[used] = np.arange(len(used))
        known = place[hashed] >= 0
        hashed, row = hashed[known], row[known]
        w, bias = descend(place[hashed], row, is_pos, len(used), prior, l1, steps, s)
        used, w = used[w != 0], w[w != 0]
    weights[used] = w
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, draw: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """``labels``: doc_id and toxic of the rows to learn from; ``draw``: the documents that may be unlabelled ones."""
    # labels of documents that an earlier stage removed belong to another population than ``draw``
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    positives = bounded_ids(known.where("toxic = 1").select("doc_id"), "doc_id", s.max_positives)
    unlabelled = bounded_ids(draw.select("doc_id").where("doc_id is not null"), "doc_id", s.max_unlabelled)
    ids = positives.withColumn("positive", F.lit(1)).unionAll(unlabelled.withColumn("positive", F.lit(0)))
    ids = ids.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.min("positive").alias("least"))
    bits = s.bits

    @F.pandas_udf("binary")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([presence(t, bits).astype("<i4").tobytes() for t in texts])

    got = (
        sampled_texts(docs, ids, "doc_id", "text", s.max_chars)
        .select("sample_id", "positive", "least", words("sample_text").alias("at"))
        .toArrow()
        .sort_by("sample_id")
    )
    arrays = [np.frombuffer(a.as_buffer(), "<i4") for a in got["at"]]
    pos = [a for a, p in zip(arrays, got["positive"].to_pylist(), strict=True) if p == 1]
    unl = [a for a, p in zip(arrays, got["least"].to_pylist(), strict=True) if p == 0]
    return fit_nnpu(pos, unl, float(prior), s)


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input
    bits = s.bits

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        return pd.Series([float(sigmoid(bias + float(weights[presence(t, bits)].sum()))) for t in texts])

    return without(docs, ["score"]).withColumn("score", scored("text"))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; held-out labels are never read."""
    model = fit(docs, labels.where(~fold("doc_id", 3, 1)), docs.where(~fold("doc_id", 3, 1)))
    out = score(without(docs, ["held_out", "predicted"]), model)
    return out.withColumns(
        {"held_out": fold("doc_id", 3, 1), "predicted": (F.col("score") >= threshold).cast("int")}
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
