"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word gives its character 1- to 3-grams between boundary marks, hashed to ``2**bits`` rows of an embedding; a text
is the average of all its rows, and a linear layer with softmax names the language. Both are
trained by stochastic gradient descent in numpy on a bounded sample. An eighth of the sampled texts, chosen by a
hash of the text so that copies and all runs of a text are on one side, is kept back: on it the temperature of the
softmax is fitted, and the rejection threshold is the smallest confidence at which accepted texts reach
``target`` accuracy.

For scoring, embedding and layer are multiplied once into one row of logits per bucket; the subwords of a
text are hashed as arrays of code points, ``slice_chars`` at a time.

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected; texts of any
length are read whole; repeated rows give the same answer; of languages with equal probability the first by name is
taken, and a confidence equal to the threshold is accepted; with no labelled text every text is
``und``; one learned language is named always; an empty table gives an empty result; columns named like the outputs
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import bounded_ids, fold, sampled_texts, ship, table, without

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    width: int = 12
    grams: tuple[int, ...] = (1, 2, 3)
    max_rows: int = 4000  # labelled texts that are fitted, the first by hash of the id
    max_chars: int = 200_000
    epochs: int = 6
    rate: float = 0.4
    pieces: int = 3  # a sampled text is also shown as short runs of its words
    piece_words: int = 8
    target: float = 0.995
    slice_chars: int = 1 << 18  # characters whose subwords are hashed at once


#: Marks around a word; ``str.split`` takes both as white space, so no word holds one.
BEGIN, END = "\x1e", "\x1f"


def buckets(words: list[str], s: Settings) -> Iterator[np.ndarray]:
    """Hashed subwords of a run of words, slice by slice; no subword reaches over the end of its word."""
    marked = f"{BEGIN}{(END + BEGIN).join(words)}{END}" if words else ""
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = max(s.grams)
    for a in range(0, len(codes), s.slice_chars):
        part = codes[a : a + s.slice_chars + longest - 1].astype(np.uint64)
        starts = min(s.slice_chars, len(codes) - a)
        inside = part != ord(END)
        key = np.zeros(len(part), np.uint64)
        whole = np.ones(len(part), bool)
        made = []
        for n in range(1, longest + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            # 21 bits of the key hold a code point plus one
            key = (key[:size] << np.uint64(21)) + part[n - 1 :] + np.uint64(1)
            if n > 1:
                whole = whole[:size] & inside[n - 2 : n - 2 + size]
            if n in s.grams:
                found = key[:starts] if n == 1 else key[:starts][whole[:starts]]
                made.append((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - s.bits))
        yield np.concatenate(made).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counted(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a run of words, and their shares."""
    rows = list(buckets(words, s))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    at, n = np.unique(np.concatenate(rows), return_counts=True)
    return at, (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket x language: embedding times layer
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings

    def mean(self, words: list[str]) -> np.ndarray:
        """Mean logits over all subwords of all ``words``, of which there is one at least."""
        total, n = np.zeros(len(self.languages)), 0
        for at in buckets(words, self.settings):
            total += self.logits[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / n

    def probabilities(self, mean_logits: np.ndarray) -> np.ndarray:
        z = (mean_logits + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def fit_sgd(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, held: np.ndarray, languages: list[str], s: Settings
) -> Model:
    """``rows``: buckets and shares of runs, in a shuffled order; those that are ``held`` only calibrate."""
    k = len(languages)
    rng = np.random.default_rng(7)
    emb = rng.uniform(-0.1, 0.1, (2**s.bits, s.width)).astype(np.float32)
    layer, bias = np.zeros((s.width, k), np.float32), np.zeros(k, np.float32)
    kept, learn = np.flatnonzero(held), np.flatnonzero(~held)
    total = s.epochs * len(learn)
    step = 0
    for _ in range(s.epochs):
        for i in rng.permutation(learn):
            at, x = rows[i]
            if not len(at):
                continue
            rate = s.rate * (1 - step / total)
            step += 1
            h = x @ emb[at]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            back = layer @ p
            layer -= rate * np.outer(h, p)
            bias -= rate * 0.1 * p
            # shares sum to one, so rows move by their share times the number of distinct rows
            emb[at] -= (rate * len(at)) * np.outer(x, back)
    model = Model(languages, (emb @ layer).astype(np.float32), bias, 1.0, 0.0, s)
    if len(kept):
        z = np.array([rows[i][1] @ model.logits[rows[i][0]] if len(rows[i][0]) else np.zeros(k) for i in kept])
        truth = y[kept]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(z)[np.arange(len(truth)), truth] + 1e-12).mean()

        model.temperature = min(np.geomspace(0.2, 5.0, 25).tolist(), key=loss)
        p = model.probabilities(z)
        sure, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-sure)
        good = np.flatnonzero(np.cumsum(right[order]) >= s.target * np.arange(1, len(order) + 1))
        model.threshold = float(sure[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, lang: str = "lang", settings: Settings = Settings()) -> Model | None:
    """Fit on the bounded sample of rows of ``docs`` (doc_id, text, lang) with a language and a letter."""
    s = settings
    ids = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.min(lang).alias("label"))
    sample = sampled_texts(docs, bounded_ids(ids, "doc_id", s.max_rows), "doc_id", "text", s.max_chars)

    @F.pandas_udf("array<struct<at:binary,x:binary>>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = text.lower().split() if has_letter(text) else []
            runs = [words] if words else []
            for j in range(s.pieces if len(words) > s.piece_words else 0):
                start = (len(words) - s.piece_words) * j // max(1, s.pieces - 1)
                runs.append(words[start : start + s.piece_words])
            made = [counted(r, s) for r in runs]
            out.append([{"at": a.astype("<i4").tobytes(), "x": x.astype("<f4").tobytes()} for a, x in made])
        return pd.Series(out)

    held_text = F.pmod(F.xxhash64("sample_text"), F.lit(8)) == 0
    got = sample.select("sample_id", "label", held_text.alias("held"), vectors("sample_text").alias("runs")).toArrow().sort_by("sample_id")
    labels = got["label"].to_pylist()
    languages = sorted(set(labels))
    if not languages:
        return None
    held_texts = got["held"].to_pylist() if len(labels) >= 16 else [False] * len(labels)
    rows, y, held = [], [], []
    for i in np.random.default_rng(3).permutation(len(labels)):
        for run in got["runs"][int(i)].as_py():
            rows.append((np.frombuffer(run["at"], "<i4"), np.frombuffer(run["x"], "<f4")))
            y.append(languages.index(labels[i]))
            held.append(held_texts[i])
    return fit_sgd(rows, np.array(y, np.int64), np.array(held, bool), languages, s)


OUTPUTS = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (calibrated confidence) and ``rejected``."""
    spark = docs.sparkSession
    docs = without(docs, OUTPUTS)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**bits rows, whatever the input

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = []
        for text in texts:
            if not has_letter(text):
                out.append((UNKNOWN, 0.0, True))
                continue
            p = m.probabilities(m.mean(text.lower().split()))
            best = int(p.argmax())
            out.append((m.languages[best], float(p[best]), bool(p[best] < m.threshold)))
        return pd.DataFrame(out, columns=list(OUTPUTS))

    return docs.withColumn("predicted_language", predicted("text")).select(
        *docs.columns, *[F.col(f"predicted_language.{c}").alias(c) for c in OUTPUTS]
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~fold("doc_id", 4, 2)))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected"
    )
