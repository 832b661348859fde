"""Best-fit packing by a plan over the histogram of lengths.

1. ``pieces``: every document is tokenised, closed with an end id, and cut only where it is longer than a
   sequence. Workers tokenise each piece of text they meet once: this tokenizer drops white space and never
   joins across it, so a text's ids are those of its words, and a word's those of the pieces that its pattern makes.
2. ``plan``: only the histogram of lengths (at most ``size`` rows) reaches the driver. Best fit, longest
   length first, places counts, not documents: ``n`` pieces of a length go to the fullest bins that
   still hold it. The plan is a list of runs: pieces of a length from rank a on sit in sequences from b on, at one
   offset. Its size depends on the number of lengths, not of documents.
3. ``packed``: a piece's rank within its length selects its run. Ranks are made in two steps, so that a
   length that holds a third of all rows is not one task: pieces of a length are dealt to
   buckets of about ``bucket_rows`` rows, bucket sizes are summed up into starts, and rows are
   numbered within buckets. Runs are joined by (length, block of ranks), each block meeting few runs.

Cases: null and empty texts are one piece holding the end id; a text longer than a sequence is cut,
nothing is dropped; repeated rows are placed each on their own (their pieces share doc_id and
piece); an empty table gives an empty result; a null doc_id is kept; other columns of the input are
not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourceloom.llm.common import settle, ship, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Settings:
    size: int = 2048
    end_id: int = 0
    words: int = 400_000  # words, and pieces, of a task's tables; they start anew when full
    bucket_rows: int = 4_000
    block: int = 4096  # ranks per block of the join with the plan


def byte_level() -> dict[int, str]:
    """Latin-1 letters as the byte-level alphabet writes their UTF-8: printable bytes stand for themselves, others move up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(chr(moved.get(b, b)) for b in chr(c).encode()) for c in range(128, 256)}


BYTE_LEVEL = byte_level()


class Numbers(dict):
    """Numbers words in the order they are met, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class IdTable:
    """Token ids of each string met, as slices of one growing array."""

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def learn(self) -> None:
        made = [self.encode(string) for string in self.at.fresh]
        if not made:
            return
        self.at.fresh = []
        last = len(self.at)
        first = last - len(made)
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        end = self.used + int(lengths.sum())
        if last > len(self.start):
            more = np.zeros(max(last, 2 * len(self.start)) - len(self.start), np.int64)
            self.start, self.length = np.append(self.start, more), np.append(self.length, more)
        if end > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(max(end, 2 * len(self.flat)) - len(self.flat), np.uint32))
        self.start[first:last] = self.used + np.cumsum(lengths) - lengths
        self.length[first:last] = lengths
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(made), np.uint32, end - self.used)
        self.used = end

    def ids(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.empty(0, np.uint32)
        if len(self.at) > self.most:
            self.clear()
        index = np.fromiter(map(self.at.__getitem__, strings), np.int64, len(strings))
        self.learn()
        length = self.length[index]
        shift = self.start[index] - (np.cumsum(length) - length)
        return self.flat[np.repeat(shift, length) + np.arange(int(length.sum()))]


class WordIds:
    """Token ids of texts. Texts of plain Latin-1 are split into pieces at once, which are fewer than words; others go word by word."""

    def __init__(self, path: str, words: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.words = IdTable(self.piece, words), IdTable(self.encode, words)

    def clear(self) -> None:
        self.pieces.clear()
        self.words.clear()

    #: The tokenizer's own split pattern for Latin-1, and the white space its normalizer drops.
    PIECE = re.compile(
        r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
    )
    WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    #: Python takes these for white space too, the tokenizer does not.
    SEPARATORS = re.compile("[\x1c-\x1f]")
    #: Neither printable Latin-1, which is composed already and has one lower-case letter each, nor its white space.
    OTHER = re.compile("[^\t-\r -~\x85\xa0-\xac\xae-\xff]")

    def piece(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece if piece.isascii() else piece.translate(BYTE_LEVEL))]

    def encode(self, word: str) -> list[int]:
        """The tokenizer's own steps one by one."""
        if "<|" in word and any(t in word for t in self.special):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        if not self.OTHER.search(word):
            return [i for p in self.PIECE.findall(word.lower()) for i in self.piece(p)]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))
        return [t.id for p, _ in split for t in self.tokenizer.model.tokenize(p)]

    def ids(self, text: str) -> np.ndarray:
        if "<|" not in text and not self.OTHER.search(text):
            return self.pieces.ids(self.PIECE.findall(text.lower()))
        return self.words.ids(self.WORD.findall(text) if self.SEPARATORS.search(text) else text.split())


WORDS: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, words: int) -> WordIds:
    """The worker's tokenizer, kept between tasks; its tables are emptied by each."""
    if (path, words) not in WORDS:
        WORDS[path, words] = WordIds(path, words)
    return WORDS[path, words]


def pieces(docs: DataFrame, s: Settings = Settings(), tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; ``ids`` adds the token ids."""
    ship(docs.sparkSession)
    path, kind = tokenizer or tokenizer_path(), docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path, s.words)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            take = []
            for i, text in enumerate(batch["text"]):
                found = np.append(known.ids(text.as_py() or ""), np.uint32(s.end_id))
                for k, start in enumerate(range(0, len(found), s.size)):
                    part = found[start : start + s.size]
                    take.append(i)
                    values = [k, start, len(part), zlib.crc32(part.astype("<u4").tobytes())] + [part] * ids
                    for out, value in zip(rows[1:], values, strict=True):
                        out.append(value)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
            arrays = [batch["doc_id"].take(pa.array(take, pa.int64()))]
            arrays += [pa.array(r, t) for r, t in zip(rows[1:], types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        known.clear()  # the worker goes on to other work

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def plan(histogram: list[tuple[int, int]], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, rows, first sequence, offset) of best fit over (length, count), longest first."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, sequences)
    free = np.zeros(size + 1, bool)
    runs, opened = [], 0
    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                space = length + int(fits[0])  # the fullest sequences that still hold it
                first, n = room[space].pop()
                free[space] = bool(room[space])
                used = min(n, count - rank)
                if used < n:
                    room[space].append((first + used, n - used))
                    free[space] = True
            else:
                space, first, used = size, opened, 0
                per = size // length  # a new sequence takes as many as fit, the rest another one
                used = max(1, (count - rank) // per) if count - rank >= per else 1
                opened += used
            runs.append((length, rank, used, first, size - space))
            rank += used
            if left := space - length:
                room[left].append((first, used))
                free[left] = True
    return runs


RUN = "length long, rank_from long, rows long, sequence_from long, offset long"


def ranked(made: DataFrame, histogram: DataFrame, s: Settings) -> DataFrame:
    """``made`` with ``rank`` from 0 within its length, without one task per length."""
    buckets = F.ceil(F.col("n") / F.lit(s.bucket_rows))
    sized = made.join(F.broadcast(histogram.select("length", buckets.alias("buckets"))), "length")  # at most size rows
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("buckets")))
    sums = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("rows_in"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "bucket", F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("rank_start"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    numbered = dealt.withColumn("nth", F.row_number().over(within) - 1)
    joined = numbered.join(starts, ["length", "bucket"])
    return joined.withColumn("rank", F.col("rank_start") + F.col("nth")).drop("buckets", "bucket", "nth", "rank_start")


def packed(made: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``made`` (a written table of pieces) with ``sequence_id`` and ``offset``."""
    spark = made.sparkSession
    histogram = made.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = [(r["length"], r["n"]) for r in histogram.collect()]  # at most s.size rows
    runs = plan(counts, s.size)
    histogram = spark.createDataFrame(counts, "length long, n long")
    blocks = F.sequence(
        F.floor(F.col("rank_from") / s.block), F.floor((F.col("rank_from") + F.col("rows") - 1) / s.block)
    )
    places = spark.createDataFrame(runs, RUN).withColumnRenamed("length", "run_length").withColumn("block", F.explode(blocks))
    rows = ranked(made, histogram, s).withColumn("rank_block", F.floor(F.col("rank") / s.block))
    inside = (
        (F.col("length") == F.col("run_length"))
        & (F.col("rank_block") == F.col("block"))
        & (F.col("rank") >= F.col("rank_from"))
        & (F.col("rank") < F.col("rank_from") + F.col("rows"))
    )
    found = rows.join(places, inside)
    return found.select(
        *made.columns, (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"
    )


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of placed pieces that carry ``ids``: each group has at most ``size`` tokens."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = settle(pieces(table(spark, sf_dir, "documents")))
    return packed(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
