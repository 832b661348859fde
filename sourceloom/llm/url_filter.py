"""URL filter: ratio of two character language models, behind host and path rules.

Two smoothed variable-order Markov models read a URL (its host, then its path): one is counted on
accepted URLs, one on rejected ones. Orders 0 to ``order`` are interpolated as in Witten-Bell
smoothing, where a context's number of distinct followers sets the weight of the shorter one. The
verdict of the models is the sign of the log-likelihood difference per character against a
threshold, calibrated on a fifth of the labelled URLs that the models do not count: the threshold
with the least balanced error.

Counting is one pass over all labelled URLs. Contexts are hashed to ``2**bits`` cells per order, each
task adds its URLs into numpy arrays, and only non-zero cells leave it, to be summed by a shuffle, so
the tables and what the driver gathers are bounded by the settings, not by the input.

Rules ``(host, path, verdict)`` come first: a rule fits its host and all subdomains when the
URL's path starts with the rule's path; the longest rule wins.

Cases: a null URL or one without ``://`` has empty host and path, meets no rule and is judged as
an empty string (difference 0); repeated URLs count each time and are judged alike; with no
accepted or no rejected URL the difference is 0 and the threshold 0, so all are allowed; long URLs
are read whole; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import mixed, ship, table, without


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    order: int = 5
    bits: int = 16
    bins: int = 2000  # of the calibration histogram


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where ``://`` is missing."""
    start = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(authority, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def cells(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash cells of contexts and of contexts with follower: (order + 1) x (length + 1) each, the end is a follower."""
    codes = np.frombuffer((text + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    context = np.zeros((s.order + 1, n), np.uint64)
    padded = np.concatenate([np.zeros(s.order, np.uint64), codes])
    for k in range(1, s.order + 1):
        context[k] = mixed(context[k - 1] * np.uint64(0x100000001B3) + padded[s.order - k : s.order - k + n])
    follower = mixed(context ^ (codes * np.uint64(0x9E3779B97F4A7C15)))
    order = np.arange(s.order + 1, dtype=np.uint64)[:, None] << np.uint64(s.bits)
    mask = np.uint64(2**s.bits - 1)
    return ((mixed(context + np.uint64(1)) & mask) | order).astype(np.int64), ((follower & mask) | order).astype(np.int64)


def likelihood(text: str, model: np.ndarray, s: Settings) -> float:
    """Log likelihood per follower; ``model`` rows: context counts, followers' counts, distinct followers."""
    at_context, at_follower = cells(text, s)
    seen, pair, distinct = model[0][at_context], model[1][at_follower], model[2][at_context]
    p = np.full(at_context.shape[1], 1.0 / 256)
    for k in range(s.order + 1):
        weight = distinct[k] + (distinct[k] == 0)
        p = (np.minimum(pair[k], seen[k]) + weight * p) / (seen[k] + weight)
    return float(np.log(p).mean())


def counts(urls: DataFrame, s: Settings) -> DataFrame:
    """(model, kind, cell, n) over all ``urls`` (text, accepted boolean); kind 0: contexts, 1: with follower."""
    size = (s.order + 1) << s.bits

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, size), np.int64)
        for batch in batches:
            for text, accepted in zip(batch["text"].to_pylist(), batch["accepted"].to_pylist(), strict=True):
                context, follower = cells(text, s)
                np.add.at(sums[int(accepted), 0], context.ravel(), 1)
                np.add.at(sums[int(accepted), 1], follower.ravel(), 1)
        model, kind, cell = np.nonzero(sums)
        for a in range(0, len(cell), 50_000):
            i = slice(a, a + 50_000)
            values = [model[i].astype(np.int32), kind[i].astype(np.int32), cell[i].astype(np.int32), sums[model[i], kind[i], cell[i]]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["model", "kind", "cell", "n"])

    found = urls.select("text", "accepted").mapInArrow(tally, "model int, kind int, cell int, n long")
    return found.groupBy("model", "kind", "cell").agg(F.sum("n").alias("n"))


def distinct_followers(urls: DataFrame, s: Settings) -> DataFrame:
    """(model, cell, n): how many different follower cells each context cell has."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bound = 1 << 17
        for batch in batches:
            fresh: set[int] = set()
            for text, accepted in zip(batch["text"].to_pylist(), batch["accepted"].to_pylist(), strict=True):
                context, follower = cells(text, s)
                keys = (context << 32) | (follower << 1) | int(accepted)
                fresh.update(keys.ravel().tolist())
            new = np.fromiter(fresh - seen, np.int64)
            seen |= fresh
            if len(seen) > bound:  # only saves repeats; the shuffle makes pairs distinct
                seen.clear()
            arrays = [(new & 1).astype(np.int32), (new >> 32).astype(np.int32), ((new >> 1) & 0x7FFFFFFF).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["model", "cell", "follower"])

    found = urls.select("text", "accepted").mapInArrow(pairs, "model int, cell int, follower int").distinct()
    return found.groupBy("model", "cell").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Ratio:
    models: np.ndarray  # rejected and accepted: context counts, pair counts, distinct followers
    ready: bool
    threshold: float
    settings: Settings


def difference(docs: DataFrame, ratio: Ratio, text: str) -> Column:
    """Log likelihood per character under the accepted model minus that under the rejected one."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # bounded by the settings

    @F.pandas_udf("double")
    def judged(texts: pd.Series) -> pd.Series:
        r = shared.value
        out = {}
        for t in texts:
            if t not in out:
                out[t] = likelihood(t, r.models[1], r.settings) - likelihood(t, r.models[0], r.settings) if t and r.ready else 0.0
        return texts.map(out)

    return judged(F.coalesce(F.col(text), F.lit("")))


def fit(labelled: DataFrame, s: Settings = Settings()) -> Ratio:
    """``labelled``: text and accepted (boolean) of URLs; a fifth of the distinct texts, by hash, calibrates."""
    ship(labelled.sparkSession)
    labelled = labelled.where("text is not null and accepted is not null and text <> ''")
    kept = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    size = (s.order + 1) << s.bits
    models = np.zeros((2, 3, size), np.float32)
    learn = labelled.where(~kept)
    tallies = counts(learn, s).toPandas()  # at most 4 * size rows
    models[tallies["model"], tallies["kind"], tallies["cell"]] = tallies["n"]
    followers = distinct_followers(learn, s).toPandas()  # at most 2 * size rows
    models[followers["model"], 2, followers["cell"]] = followers["n"]
    ratio = Ratio(models, bool(models[0].any() and models[1].any()), 0.0, s)
    if ratio.ready:
        judged = labelled.where(kept).select("accepted", difference(labelled, ratio, "text").alias("d"))
        bins = judged.groupBy(F.floor(F.greatest(F.least("d", F.lit(10.0)), F.lit(-10.0)) * (s.bins / 20)).alias("bin")).agg(
            F.sum(F.col("accepted").cast("long")).alias("good"), F.sum((~F.col("accepted")).cast("long")).alias("bad")
        )
        hist = bins.orderBy("bin").toPandas()  # at most ``bins`` + 1 rows
        if len(hist) and hist["good"].sum() and hist["bad"].sum():
            good = np.append(0, hist["good"].cumsum()) / hist["good"].sum()  # accepted below the threshold
            bad = 1 - np.append(0, hist["bad"].cumsum()) / hist["bad"].sum()  # rejected at or above it
            edges = np.append(hist["bin"], hist["bin"].iloc[-1] + 1) * (20 / s.bins)
            error = good + bad
            best = np.flatnonzero(error <= error.min() + 1e-12)
            ratio.threshold = float(edges[best[len(best) // 2]])
    return ratio


OUTPUTS = ("host", "path", "rule", "rule_verdict", "difference", "verdict")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: Ratio | None = None, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``rule_verdict``, ``difference`` and ``verdict``.

    Without a fitted ``ratio``, URLs that a rule allows are the accepted ones and those that a rule blocks the
    rejected ones.
    """
    host, path = parts(F.col(url))
    pages = without(pages, OUTPUTS).withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": name, "rule_verdict": verdict, "url_text": F.concat("host", "path")})
    if ratio is None:
        ratio = fit(pages.select(F.col("url_text").alias("text"), (F.col("rule_verdict") == "allow").alias("accepted")))
    pages = pages.withColumn("difference", difference(pages, ratio, "url_text"))
    by_model = F.when(F.col("difference") >= ratio.threshold, "allow").otherwise("block")
    if not ratio.ready:
        by_model = F.lit("allow")
    return pages.withColumn("verdict", F.coalesce("rule_verdict", by_model)).drop("url_text")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "difference")
