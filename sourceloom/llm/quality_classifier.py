"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Tokens are runs of word characters or of punctuation. A token equal to the one before it is
replaced by a repeat mark, so that stutter looks alike whatever word stutters. Unigrams and bigrams are hashed to
``2**bits`` weights; a document is the vector of ``1 + log(count)`` with length one. Weights are
updated per document and coordinate (FTRL-proximal), and a score is a sparse dot product.

Cases: null and empty texts have no features and score the intercept; texts of any length are
read whole; repeated rows score alike; without labels of both kinds every score is the share of
label 1 (0.5 with no label at all); columns named like the outputs are replaced, others stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import bounded_ids, fold, mixed, sampled_texts, ship, sigmoid, table, without, word_hashes

TOKEN = re.compile(r"\w+|[^\w\s]+")
REPEAT = np.uint64(0x5EED)
ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values (a vector of length one) of a whole text."""
    words = word_hashes(TOKEN.findall(text or ""))
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    marked = words.copy()
    marked[1:][words[1:] == words[:-1]] = REPEAT
    pairs = mixed(marked[:-1] * ODD + marked[1:])
    grams = np.concatenate([mixed(marked), pairs]) >> np.uint64(64 - bits)
    found, counts = np.unique(grams.astype(np.int64), return_counts=True)
    values = 1.0 + np.log(counts)
    return found, (values / np.sqrt((values * values).sum())).astype(np.float32)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_rows: int = 6000  # labelled rows that are fitted, the first by hash of the id
    max_chars: int = 200_000  # longer texts are not drawn for fitting
    epochs: int = 6
    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept; rows are visited in the given order, ``epochs`` times."""
    z, n, bias = np.zeros(2**s.bits), np.zeros(2**s.bits), 0.0
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(2**s.bits, np.float32), float(np.log(share / (1 - share)))
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    for _ in range(s.epochs):
        for (at, x), y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = np.where(
                np.abs(zi) > s.l1,
                -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2),
                0.0,
            )
            error = sigmoid(float(w @ x) + bias) - y
            g = error * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / s.alpha * w
            n[at] = grown
            bias_n += error * error
            bias -= 0.1 / (1.0 + np.sqrt(bias_n)) * error
    w = np.where(np.abs(z) > s.l1, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)
    return w.astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> tuple:
    """Fit on the bounded sample of labelled rows; ``labels`` has ``doc_id`` and the label column."""
    ids = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    sample = sampled_texts(docs, bounded_ids(ids, "doc_id", settings.max_rows), "doc_id", "text", settings.max_chars)
    bits = settings.bits

    @F.pandas_udf("at binary, x binary")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        found = [features(t, bits) for t in texts]
        return pd.DataFrame({"at": [a.astype("<i4").tobytes() for a, _ in found], "x": [x.tobytes() for _, x in found]})

    got = sample.select("sample_id", "label", vectors("sample_text").alias("v")).select("sample_id", "label", "v.*").toArrow()
    ids = got["sample_id"].to_numpy().astype(np.int64)
    order = np.argsort(mixed(ids.view(np.uint64)), kind="stable")
    pairs = [(np.frombuffer(got["at"][i].as_buffer(), "<i4"), np.frombuffer(got["x"][i].as_buffer(), "<f4")) for i in order]
    y = got["label"].to_numpy().astype(float)[order]
    return fit_ftrl(pairs, y, settings)


def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input
    bits = settings.bits

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            at, x = features(text, bits)
            out[i] = bias + float(weights[at] @ x)
        return pd.Series(sigmoid(out))

    return without(docs, ["score"]).withColumn("score", scored("text"))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; held-out labels are never read."""
    learn = labels.where(~fold("doc_id", 5, 0))
    out = score(without(docs, ["held_out", "predicted"]), fit(docs, learn))
    return out.withColumns(
        {"held_out": fold("doc_id", 5, 0), "predicted": (F.col("score") >= threshold).cast("int")}
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
