"""Benchmark decontamination: SimHash windows of item size, multi-index Hamming search, exact check.

Words are lower-cased runs of letters and digits. Every item has a 64-bit SimHash of its words. In a document, windows as long as
items (each word count that items have) get theirs from running sums of word bits, at every offset
that can matter: with similarity s a window and an item of m shingles share 2 s m / (1 + s) of them,
so only windows that hold as many shingles of items at all are made. ``radius + 1`` blocks of the 64 bits are indexed: two fingerprints
within ``radius`` differ in at most ``radius`` bits, so they agree in one block at least, and the
search loses none within the radius. Candidates are verified: sum of minima over sum of maxima of
the shingle counts of window and item (five words a shingle) must reach ``similarity``.

Items are read in blocks of at most ``block_items``, each a broadcast of bounded size; a larger
benchmark takes more blocks in the same pass over the documents. No document leaves its row:
there is no shuffle.

Cases: null, empty and wordless texts match nothing; items without words are skipped; an item
shorter than a shingle is one shingle of all its words; texts are read whole; repeated rows and
repeated items are each reported; an empty benchmark matches nothing; columns named like the
output are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import CACHE_WORDS, mixed, ship, table, without


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    radius: int = 15
    block_items: int = 20_000


WORD = re.compile(r"[^\W_]+")


class NormalHashes(dict):
    """Word -> 64-bit hash of it in lower case; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h


HASHES = NormalHashes()
FACTOR = np.uint64(0xD6E8FEB86659FD93)
BITS = np.arange(64, dtype=np.uint64)


def words_of(text: str | None) -> np.ndarray:
    raw = WORD.findall(text or "")
    return np.fromiter(map(HASHES.__getitem__, raw), np.uint64, len(raw))


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of ``words`` words, or of all of them where there are fewer."""
    n = min(words, len(h))
    out = np.full(max(0, len(h) - n + 1) if n else 0, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * FACTOR + h[k : len(h) - n + 1 + k]
    return mixed(out)


def signs(h: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 per word."""
    return (((mixed(h)[:, None] >> BITS) & np.uint64(1)).astype(np.int32) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << BITS).sum(axis=1, dtype=np.uint64)


def weighted(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the counts."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return shared / (len(a) + len(b) - shared)


class Items:
    """Fingerprints of a block of items by word count, and their multi-index."""

    def __init__(self, ids: list, texts: list[str], s: Settings):
        self.s, self.ids = s, ids
        self.words = [words_of(t) for t in texts]
        self.grams = [shingles(h, s.words) for h in self.words]
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *self.grams]))
        #: Word counts of the items that have each known shingle.
        self.lengths_of: list[set[int]] = [set() for _ in self.known]
        for h, grams in zip(self.words, self.grams, strict=True):
            for i in np.searchsorted(self.known, grams).tolist():
                self.lengths_of[i].add(len(h))
        #: Lengths of items shorter than a shingle; their only shingle has that many words.
        self.short = sorted({len(h) for h in self.words if 0 < len(h) < s.words})
        by_length: dict[int, list[int]] = {}
        for i, h in enumerate(self.words):
            if len(h):
                by_length.setdefault(len(h), []).append(i)
        cuts = np.linspace(0, 64, s.radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.index = {}
        for length, at in by_length.items():
            prints = np.array([fingerprints(signs(self.words[i]).sum(axis=0)[None, :])[0] for i in at], np.uint64)
            tables = []
            for shift, mask in self.blocks:
                part = (prints >> shift) & mask
                order = np.argsort(part, kind="stable")
                tables.append((part[order], order))
            self.index[length] = (np.array(at), prints, tables)

    def near(self, length: int, prints: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) pairs within the radius."""
        at, items, tables = self.index[length]
        found: set[tuple[int, int]] = set()
        for (shift, mask), (parts, order) in zip(self.blocks, tables, strict=True):
            part = (prints >> shift) & mask
            first, last = np.searchsorted(parts, part, "left"), np.searchsorted(parts, part, "right")
            n = last - first
            window = np.repeat(np.arange(len(prints)), n)
            place = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            close = np.bitwise_count(prints[window] ^ items[place]) <= self.s.radius
            found.update(zip(window[close].tolist(), at[place[close]].tolist(), strict=True))
        return found

    def search(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """(item, similarity, first character, end) of the passages of a whole text that match."""
        h = words_of(text)
        seen = {}  # running counts of shingles of any item, by words of a shingle
        lengths: set[int] = set()  # of the items that have a shingle here; no other can match
        for n in [self.s.words, *self.short]:
            if n <= len(h) and len(self.known):
                grams = shingles(h, n)
                place = np.searchsorted(self.known, grams)
                place[place == len(self.known)] = 0
                hit = self.known[place] == grams
                seen[n] = np.append(0, np.cumsum(hit))
                lengths.update(*(self.lengths_of[i] for i in np.unique(place[hit]).tolist()))
        if not lengths:
            return []
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(h), axis=0, dtype=np.int32)])
        matches = []
        for length in sorted(lengths):
            if length > len(h):
                continue
            n = min(self.s.words, length)
            grams = length - n + 1
            need = math.ceil(2 * self.s.similarity / (1 + self.s.similarity) * grams - 1e-9)
            count = seen[n][grams:] - seen[n][: len(seen[n]) - grams]
            starts = np.flatnonzero(count >= need)
            for a in range(0, len(starts), 8192):
                part = starts[a : a + 8192]
                for w, item in self.near(length, fingerprints(sums[part + length] - sums[part])):
                    start = int(part[w])
                    similarity = weighted(shingles(h[start : start + length], self.s.words), self.grams[item])
                    if similarity >= self.s.similarity:
                        matches.append((-similarity, start, length, item))
        return self.best(text or "", matches)

    def best(self, text: str, matches: list[tuple[float, int, int, int]]) -> list[tuple[object, float, int, int]]:
        """Of overlapping windows of one item the most similar one, the first of equals."""
        if not matches:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        taken: dict[int, list[tuple[int, int]]] = {}
        out = []
        for similarity, start, length, item in sorted(matches):
            if all(start >= b or start + length <= a for a, b in taken.get(item, [])):
                taken.setdefault(item, []).append((start, start + length))
                out.append((self.ids[item], -similarity, spans[start][0], spans[start + length - 1][1]))
        return sorted(out, key=lambda m: (m[2], str(m[0])))


def searcher(shared: Broadcast, shape: str):
    """The search for one block of items, as a column function of the text."""

    @F.pandas_udf(shape)
    def searched(texts: pd.Series) -> pd.Series:
        names = ("item_id", "similarity", "begin", "end")
        return pd.Series([[dict(zip(names, m, strict=True)) for m in shared.value.search(t)] for t in texts])

    return searched


def matched(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``matches``: array of (item_id, similarity, begin, end); ``items``: item_id and text."""
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    shape = f"array<struct<item_id:{kind},similarity:double,begin:int,end:int>>"
    items = items.select("item_id", "text").where("text is not null")
    docs = without(docs, ["matches"])
    found = F.expr("array()").cast(shape)
    for k in range(n := max(1, math.ceil(items.count() / s.block_items))):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([r[0] for r in block], [r[1] for r in block], s))

        searched = searcher(shared, shape)("text")
        found = searched if n == 1 else F.concat(found, searched)
    return docs.withColumn("matches", found)


def clean(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without any match."""
    return matched(docs, items, s).where(F.size("matches") == 0).drop("matches")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per matching passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matched(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
