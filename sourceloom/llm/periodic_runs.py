"""Periodic run detection with string synchronising sets, and texts whose runs are collapsed to one period.

A run is a stretch of words with smallest period q and at least ``max(shortest, repeats * q)`` words that no neighbouring
word extends. All texts of a batch are one array of word numbers with a number of its own after each text; longer texts
come first, so that the texts long enough for a scale are the start of the array.

1. Identifiers of the windows of 1, 2, 4, .. words are made by doubling. At scale t = 2**k a place is synchronising if the
   least identifier of the windows that start within t words of it stands at the place itself or t words on. This depends
   on the next 2t words only, so equal contexts are both synchronising or both not.
2. Windows inside a known run whose period is at most t / 4 take no part in the minimum: these highly periodic regions
   are detected before, at the smaller scales, where their periods were reported. What is left has O(n / t) places.
3. Of each synchronising place and the next one with an equal context, at distance q with t <= q < 2t, q is proposed as a
   period. A run of period q in that range and of 4q words has such a place within its first t words: otherwise
   its first 3t - 1 words would have a period of at most t / 4 besides q, hence one that divides q. The same argument shows
   that no equal context lies between the two.
4. Proposals of one period whose contexts overlap by a period are one stretch. It is extended word by word in both
   directions, compared exactly, and reported if it is long enough.

Identifiers are 64-bit hashes; what they propose is verified word by word. Every scale costs a few array passes over the
texts of at least 4t words, so a batch takes O(n log n).

Cases: null and empty texts have no words and no runs; texts are read whole, with memory in proportion to a batch (bounded by
``batch_words`` or one text); rows are judged one by one, so repeated rows give repeated results; a null id counts as the
empty text in its hash; the greatest run is the longest, then the first, then that of the least period; an empty table gives an
empty result; columns named like the outputs are replaced, others stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import mixed, ship, table, without

EMPTY = np.empty((0, 3), np.int64)
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    shortest: int = 6
    repeats: int = 4  # at least 4: the proposals rely on it
    batch_words: int = 400_000


def window_minima(ids: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by minima from both ends of blocks of that width."""
    n = len(ids)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    blocks[:n] = ids
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any stretch [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def proposals(ids: np.ndarray, context: np.ndarray, busy: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of equal neighbouring contexts of synchronising places at scale ``t``."""
    free = np.where(busy, np.iinfo(np.uint64).max, ids)
    least = window_minima(free, t + 1)
    places = np.flatnonzero((least < np.iinfo(np.uint64).max) & ((free[: len(least)] == least) | (free[t:] == least)))
    places = places[places < len(context)]
    order = np.argsort(context[places], kind="stable")
    places = places[order]
    gap = np.diff(places)
    same = (context[places[1:]] == context[places[:-1]]) & (gap >= t) & (gap < 2 * t)
    return places[:-1][same], gap[same]


def extended(words: np.ndarray, start: int, end: int, q: int) -> tuple[int, int]:
    """The maximal stretch of period ``q`` around [start, end), which may turn out empty at a false proposal."""
    if (words[start : end - q] != words[start + q : end]).any():
        return start, start
    step = max(16, q)
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + q : start + q])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    step, n = max(16, q), len(words)
    while end < n:
        high = min(n, end + step)
        differ = np.flatnonzero(words[end:high] != words[end - q : high - q])
        if len(differ):
            return start, end + int(differ[0])
        end, step = high, 2 * step
    return start, end


def runs(words: np.ndarray, long_enough: list[int], s: Settings = Settings()) -> np.ndarray:
    """(start, end, period) of all runs, by start, then period.

    ``words``: numbers of words, texts separated by numbers that occur once. ``long_enough[k]``: how much of the
    start of the array belongs to texts of at least ``4 * 2**k`` words.
    """
    found: set[tuple[int, int, int]] = set()
    hashes = mixed(words.astype(np.uint64) * ODD + np.uint64(1))
    t, small = 1, EMPTY
    for n in long_enough:
        if n < 2 * t:
            break
        hashes = hashes[: max(0, n - t + 1)]
        context = mixed(hashes[:-t] * ODD + mixed(hashes[t:]))
        inside = small[(4 * small[:, 2] <= t) & (small[:, 0] < len(hashes))]
        # windows of t words within a run, so those that start no later than t words before its end
        stop = np.minimum(inside[:, 1] - t + 1, len(hashes))
        sound = stop > inside[:, 0]
        busy = covered(len(hashes), inside[sound, 0], stop[sound])
        at, period = proposals(hashes, context, busy, t)
        if len(at):
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            fresh = np.append(True, (period[1:] != period[:-1]) | (np.diff(at) > 2 * t))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(at)) - 1
            for a, b, q in zip(at[first].tolist(), at[last].tolist(), period[first].tolist(), strict=True):
                a, b = extended(words, a, b + q + 2 * t, q)
                if b - a >= s.repeats * q:
                    found.add((a, b, q))
            small = np.array(sorted(found), np.int64).reshape(-1, 3)
        hashes, t = context, 2 * t
    return small[small[:, 1] - small[:, 0] >= s.shortest]


def tampered(n: int, doc_id) -> np.ndarray | None:
    """Where each word of a document comes from, if its id asks for a planted period; None if not."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def summary(words: list[bytes], found: np.ndarray, s: Settings) -> tuple:
    """The columns of one text; ``found`` counts from its first word."""
    kept = words
    if len(found):
        gone = covered(len(words), found[:, 0] + found[:, 2], found[:, 1])
        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
        length = found[:, 1] - found[:, 0]
        lines = "".join(f"{a},{n},{q}\n" for (a, _, q), n in zip(found.tolist(), length.tolist(), strict=True))
        at = int(np.argmax(length))  # the first of the longest; rows are by start, then period
        top = (int(found[at, 0]), int(length[at]), int(found[at, 2]), int(1000 * length[at] // found[at, 2]))
    else:
        lines, top = "", (None, None, None, None)
    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
    return len(found), *top, *digests


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def summaries(texts: list[str | None], ids: list | None, s: Settings = Settings()) -> list[tuple]:
    """The columns of each text. ``ids``: document ids that may ask for a planted period, or None for texts as they are."""
    split = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    if ids is not None:
        for i, doc_id in enumerate(ids):
            source = tampered(len(split[i]), doc_id)
            if source is not None:
                split[i] = [split[i][k] for k in source.tolist()]
    lengths = np.array([len(split[i]) for i in order], np.int64)
    number, _ = pd.factorize(np.array([w for i in order for w in split[i]], dtype=object))
    # every text is followed by a number of its own
    starts = np.append(0, np.cumsum(lengths + 1))
    flat = np.full(int(starts[-1]), -1, np.int64)
    if len(number):
        flat[np.arange(len(number)) + np.repeat(np.arange(len(lengths)), lengths)] = number
    flat[flat < 0] = len(number) + np.arange(len(lengths))
    reach, t = [], 1
    while len(lengths) and 4 * t <= lengths[0]:
        reach.append(int(starts[int(np.searchsorted(-lengths, -4 * t, side="right"))]))
        t *= 2
    found = runs(flat, reach, s)
    cut = np.searchsorted(found[:, 0], starts)
    out: list[tuple] = [()] * len(texts)
    for place, i in enumerate(order):
        own = found[cut[place] : cut[place + 1]] - np.array([starts[place], starts[place], 0])
        out[i] = summary(split[i], own, s)
    return out


def described(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """``docs`` with the run columns of every whole text; with ``planted``, of the text that the contract derives from it."""
    ship(docs.sparkSession)
    docs = without(docs, NAMES)

    @F.pandas_udf(SCHEMA)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            ids, texts = [None if pd.isna(i) else i for i in ids.tolist()], texts.tolist()
            rows, at = [], 0
            while at < len(texts):  # whole texts, up to a number of characters that holds batch_words at most
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= 2 * s.batch_words):
                    size += len(texts[end] or "")
                    end += 1
                rows += summaries(texts[at:end], ids[at:end] if planted else None, s)
                at = end
            columns = dict(zip(NAMES, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in NAMES}
            yield pd.DataFrame({n: pd.Series(columns[n], dtype=object if "sha" in n else "Int64") for n in NAMES})

    rows = docs.select(F.struct(*docs.columns).alias("kept"), made(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("made"))
    return rows.select("kept.*", "made.*")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return described(docs, planted=True).drop("text")
