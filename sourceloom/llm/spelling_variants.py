"""Spelling variants: words that one edit separates, by Gram matrices of letter counts, and the form each belongs to.

1. Words are counted per text in the tasks and summed by one shuffle with partial sums; only words of at least
   ``min_chars`` code points and ``min_count`` occurrences go on.
2. A word's letter counts are a vector. Words at one edit have squared distance 1 (insertion, deletion; lengths differ
   by one) or 2 (replacement; equal lengths). Letters fall into ``classes`` classes, so the class sums of such words differ by
   one step or by one exchange: words of equal class sums are a block, and a block only meets itself and the blocks one
   step or exchange away, which lie in the same or an adjacent length.
3. Blocks of more than ``tile`` words are split by hash into tiles of about that size. A tile and the tiles of one number of
   all blocks it meets are one row, whichever task it falls to; a task multiplies the count matrices, reads squared distances
   off the Gram matrix strip by strip, and keeps pairs at the right distance. Nothing but those is emitted, after the
   edit itself was verified letter by letter.
4. Near words are symmetric. A word's form is its near word of largest count that is at least ``ratio`` times its own; the root
   follows forms to the last by pointer doubling (counts at least double at each step, so a few joins suffice).

Cost: a tile pair costs tile**2 multiply-adds per letter. Blocks are few rows of the distinct vocabulary only, which grows far
slower than the text; the largest block is spread over as many tasks as it has tile pairs.

Cases: null and empty texts have no words; texts are read whole; null ids count as the empty text in the hash; repeated
rows count again; equal counts of near words are settled by code-point order; an empty table gives an empty result;
other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import settle, ship, table

RUN = re.compile(r"[a-zÀ-ÿ]+")


@dataclass(frozen=True)
class Settings:
    min_chars: int = 5
    min_count: int = 3
    ratio: int = 2
    typo_mod: int = 97  # a run whose hash it divides loses a letter; 0: texts as they are
    classes: int = 8
    tile: int = 1_000
    strip: int = 4_000_000  # distances that are held at once
    held: int = 200_000  # distinct words that a task sums before it hands them on


def words_of(text: str | None, doc_id: str | None, typo_mod: int) -> Counter:
    """Occurrences of the words of one text; bytes are lower-cased, which changes A-Z only."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs = Counter(RUN.findall(lowered))
    if not typo_mod:
        return runs
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % typo_mod == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words that are long and frequent enough."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= s.min_chars]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for i, t in zip(batch[0], batch[1], strict=True):
                for word, n in words_of(t.as_py(), i.as_py(), s.typo_mod).items():
                    held[word] += n
                if len(held) >= s.held:
                    yield flush()
                    held = Counter()
        yield flush()

    rows = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= s.min_count)


def class_sums(s: Settings) -> list[Column]:
    """How many letters of ``word`` fall into each class: code points by remainder, so that frequent letters are spread."""
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    columns = []
    for k in range(s.classes):
        others = "".join(x for i, x in enumerate(letters) if i % s.classes != k)
        columns.append(F.length(F.translate("word", others, "")))
    return columns


def moves(s: Settings) -> list[list[int]]:
    """From a block to those it meets as the first of the two: one exchange on, one step on. Itself is not among them."""
    unit = [[int(i == k) for i in range(s.classes)] for k in range(s.classes)]
    return unit + [[a - b for a, b in zip(unit[i], unit[j], strict=True)] for i in range(s.classes) for j in range(i)]


def tiles_of(words: DataFrame, s: Settings) -> DataFrame:
    """(block, tile, words): words joined by blanks, about ``tile`` of them as the number of tiles follows from the block's size."""
    rows = words.select("word", F.array(*class_sums(s)).alias("block"))
    sizes = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / s.tile).cast("int").alias("tiles"))
    placed = rows.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    return placed.groupBy("block", "tile").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("words"))


def near_pairs(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b): words one edit apart, each pair once. ``words``: distinct ``word``."""
    ship(words.sparkSession)
    tiles = settle(tiles_of(words, s))
    steps = F.array(*[F.array(*map(F.lit, move)) for move in moves(s)])
    first = F.transform(steps, lambda m: F.zip_with("block", m, lambda x, y: x - y))  # blocks that meet this one
    others = tiles.select(F.explode(first).alias("block"), F.col("tile").alias("other"), F.col("words").alias("w"))
    # at most one tile of each block met, so as many words as there are moves times the size of a tile
    others = others.groupBy("block", "other").agg(F.array_join(F.collect_list("w"), " ").alias("others"))
    own = tiles.select("block", F.col("tile").alias("other"), F.col("words").alias("others"))
    met = tiles.join(others, "block").select("words", "others", F.lit(False).alias("same"))
    inside = tiles.join(own, "block").where(F.col("tile") <= F.col("other"))
    met = met.unionAll(inside.select("words", "others", (F.col("tile") == F.col("other")).alias("same")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch[k] for k in range(3)], strict=True):
                a, b, same = (x.as_py() for x in row)
                a, b = a.split(" "), b.split(" ")
                for extra in (0, 1):  # the words of ``a`` have one length
                    other = [w for w in b if len(w) == len(a[0]) + extra]
                    for i, j in close(a, other, same, s.strip) if other else ():
                        pairs = [pa.array([a[k] for k in i], pa.string()), pa.array([other[k] for k in j], pa.string())]
                        yield pa.RecordBatch.from_arrays(pairs, names=["a", "b"])

    return met.mapInArrow(compare, "a string, b string")


def letter_counts(letters: np.ndarray, column: np.ndarray, kind: type) -> np.ndarray:
    """One row of letter counts per word; ``column`` gives the place of each code point."""
    width = int(column.max()) + 1
    places = (np.arange(len(letters)) * width)[:, None] + column[letters]
    return np.bincount(places.ravel(), minlength=width * len(letters)).reshape(-1, width).astype(kind)


def close(a: list[str], b: list[str], same: bool, strip: int) -> Iterator[tuple[list[int], list[int]]]:
    """Places of words one edit apart; with ``same``, each pair once.

    The words of each side have one length, that of ``b`` is the same or one more. All code points are below 256.
    """
    letters_a, letters_b = (np.frombuffer("".join(w).encode("latin-1"), np.uint8).reshape(len(w), -1) for w in (a, b))
    used = np.bincount(np.concatenate([letters_a.ravel(), letters_b.ravel()]), minlength=256) > 0
    column = np.cumsum(used) - 1
    # whole numbers below 2**24, so single precision is exact, unless words are extremely long
    kind = np.float32 if letters_b.shape[1] < 2048 else np.float64
    x, y = letter_counts(letters_a, column, kind), letter_counts(letters_b, column, kind)
    square_a, square_b = (x * x).sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)
    wanted = kind(2 if len(a[0]) == len(b[0]) else 1)
    # one product gives |x|^2 + |y|^2 - 2xy - wanted
    left = np.hstack([-2 * x, square_a, np.ones_like(square_a)])
    right = np.hstack([y, np.ones_like(square_b), square_b - wanted]).T
    step = max(1, strip // len(b))
    for start in range(0, len(a), step):
        i, j = np.nonzero(left[start : start + step] @ right == 0)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        part = max(1, strip // letters_b.shape[1])
        for k in range(0, len(i), part):
            p, q = i[k : k + part], j[k : k + part]
            sound = one_edit(letters_a[p], letters_b[q])
            yield p[sound].tolist(), q[sound].tolist()


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: is ``b`` one replacement, or with one letter more one insertion, away from ``a``?"""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a == b[:, :-1], a == b[:, 1:]
    lead = np.where(ahead.all(axis=1), n, np.argmin(ahead, axis=1))
    trail = np.where(behind.all(axis=1), n, np.argmin(behind[:, ::-1], axis=1))
    return lead + trail >= n


def grouped(counted: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n)."""
    counted = settle(counted)
    pairs = settle(near_pairs(counted, s))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"))
    both = both.unionAll(both.select(F.col("near").alias("word"), F.col("word").alias("near")))
    named = both.join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = named.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    rows = counted.join(best, "word", "left")
    fits = -F.col("best.less") >= s.ratio * F.col("n")
    rows = rows.select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    rows = settle(rows)
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(links.join(onward, "root", "left"))
        links = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.where("next is not null").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(table(spark, sf_dir, "documents")))
