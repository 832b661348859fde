"""Exact substring deduplication: bytes that a string of ``length`` bytes covers which starts anywhere else are removed.

1. A window of ``length`` bytes is known by its least gram: the hash of ``gram`` bytes that is least in it, the first of equal
   ones. Equal windows have equal least grams, so a window whose least gram occurs once in all texts repeats nothing. Grams are
   counted by a shuffle with partial sums, and those of at least two go to a bitmap of bounded size.
2. Neighbouring windows with the same least gram are a segment; the segments whose gram is in the bitmap are made, in which every
   window of the text lies once. Equal segments of a task are one row with a count.
3. Segments meet by gram. A gram with more than ``hot`` bytes of segments is split: of its windows, some hold at least half of
   the free bytes before the gram, the others more than half of them behind it, and both have a longer string in common by which they
   are grouped anew. A few such steps end at whole windows, which are then equal. So no gram is too much for a task.
4. Equal windows have the gram at the same place. So each segment of a gram is cut to what it can share: the bytes before and from
   the gram that it has in common with any other, which are those of its neighbours in the order of what goes before, and of what
   follows. Segments that are equal then repeat wholly, and a gram with one such stretch is done. The others of a task are sorted
   as suffixes by external induced sorting (``suffix_sort``). A window repeats if the suffix there has ``length`` bytes in common
   with a neighbour, or if its segment was met twice.
5. Spans go back to the segments they were split from, then to the texts by the segments' digests. Digests of many rows are salted by
   their own number of rows. A digest counts as such from a share of all rows, so that a bounded number of them is broadcast.

A row is known by its id and the hash of its text; equal texts have equal spans, so repeated rows repeat their results. Digests
have 128 bits. Bytes are those of UTF-8; what is left is binary, since cuts may fall inside a character.

Cases: null texts are empty; texts shorter than ``length`` repeat nothing; long texts are cut into blocks of windows, which
overlap in bytes, not in windows; null ids are kept apart by their texts; an empty table gives an empty result; other columns
stay, those named like the outputs are replaced.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import forget, mixed, settle, ship, small_batches, table, without
from sourceloom.llm.periodic_runs import window_minima
from sourceloom.llm.suffix_sort import Scratch, suffix_order

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLACE = np.uint64(2**22 - 1)


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 100
    block: int = 2**20  # windows of a text that are cut at once
    shard: int = 900_000  # bytes of segments that a task sorts, about
    hot: int = 32_000_000  # bytes of segments of one gram beyond which it is split
    held: int = 16_000_000  # bytes of segments that a task gathers before it hands them on
    salt: int = 20_000  # rows of one digest from which the join to the texts is salted, at least
    salted: int = 100_000  # digests that are salted, at most
    bits: int = 28  # of the bitmap, at most
    memory: int = 256_000_000  # bytes of a shard's arrays and queues beyond which they go to disk
    base: int = 8_000_000  # names that are told apart in memory
    batch: int = 500  # rows that a Python worker gets at once: the segments of so many texts are listed together


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        return cls.up[:n], cls.down[:n]


def segments(raw: np.ndarray, s: Settings) -> list[tuple[np.ndarray, ...]]:
    """(gram, place of it, first window, window after the last) per segment of a text, block by block."""
    out = []
    for start in range(0, len(raw) - s.length + 1, s.block):
        part = raw[start : start + s.block + s.length - 1]
        up, down = Powers.of(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        grams = mixed((sums[s.gram :] - sums[: -s.gram]) * down[: len(part) - s.gram + 1])
        ranked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        at = (window_minima(ranked, s.length - s.gram + 1) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append((grams[at[first]], at[first] + start, first + start, np.append(first[1:], len(at)) + start))
    return out


def raw_bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)


def frequent_grams(docs: DataFrame, s: Settings) -> DataFrame:
    """(gram): least grams that at least two segments have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for text in batch["text"]:
                held += [part[0] for part in segments(raw_bytes(text), s)]
                if len(held) >= 4096:
                    yield counted(held)
                    held = []
        yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    found = docs.select("text").mapInArrow(emit, "gram long, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def bitmap(grams: DataFrame, s: Settings) -> np.ndarray:
    """One bit per value of the low bits of the grams; at most ``2**bits`` bits, in rows of 4 KB, reach the driver."""
    n = grams.count()
    width = 2 ** min(s.bits, max(16, (16 * n).bit_length()))
    low = F.pmod("gram", F.lit(width)) + 1  # Spark's buckets and bits count from 1
    rows = grams.select(low.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    out = np.zeros(width // 8, np.uint8)
    for row in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        part = np.frombuffer(row["bits"], np.uint8)
        start = (row["bucket"] - 1) * 4096
        out[start : start + len(part)] = part[: max(0, len(out) - start)]
    return out


SEGMENT = "gram long, low int, high int, d1 long, d2 long, n long, content binary"
FIELDS = ["gram", "low", "high", "d1", "d2", "n", "content"]


def digest(content: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(content)
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


class Gathered:
    """Distinct segments of a task with their counts; emptied when they exceed a number of bytes."""

    def __init__(self, limit: int):
        self.limit, self.size, self.rows = limit, 0, {}

    def add(self, gram: int, low: int, high: int, key: tuple[int, int], n: int, content: bytes) -> None:
        row = self.rows.get((gram, key))
        if row is not None:
            row[5] += n
            return
        self.rows[gram, key] = [gram, low, high, *key, n, content]
        self.size += len(content) + 200

    def taken(self) -> list[list]:
        columns = list(zip(*self.rows.values(), strict=True)) or [()] * len(FIELDS)
        self.rows, self.size = {}, 0
        return columns


def repeated_segments(docs: DataFrame, frequent: np.ndarray, s: Settings) -> DataFrame:
    """Segments with a gram in the bitmap (``n`` is set) and where they stand (``start`` is set), in one table."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"{SEGMENT}, doc_id {kind}, mark long, start long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.uint64(8 * len(bits) - 1)
        found = Gathered(s.held)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [*FIELDS, "doc_id", "mark", "start"]

        def flushed(id_type) -> pa.RecordBatch:
            columns = found.taken()
            rows = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            n = len(rows[0])
            return pa.RecordBatch.from_arrays([*rows, pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 2], names=names)

        id_type = None
        for batch in batches:
            id_type = batch["doc_id"].type
            owner, starts, keys = [], [], []
            for i, text in enumerate(batch["text"]):
                raw = raw_bytes(text)
                for grams, at, first, end in segments(raw, s):
                    low = grams & mask
                    kept = np.flatnonzero((bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
                    whole = raw.tobytes() if len(kept) else b""
                    rows = (x[kept].tolist() for x in (grams.view(np.int64), at, first, end))
                    for gram, p, a, b in zip(*rows, strict=True):
                        content = whole[a : b + s.length - 1]
                        key = digest(content)
                        found.add(gram, p - a, p - a + s.gram, key, 1, content)
                        keys.append(key)
                    owner += [i] * len(kept)
                    starts += first[kept].tolist()
                    if found.size >= s.held:
                        yield flushed(id_type)
            d1, d2 = zip(*keys, strict=True) if keys else ((), ())
            n = len(owner)
            where = pa.array(owner, pa.int64())
            none = [pa.nulls(n, t) for t in types]
            none[3], none[4] = pa.array(d1, pa.int64()), pa.array(d2, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*none, batch["doc_id"].take(where), batch["mark"].take(where), pa.array(starts, pa.int64())], names=names
            )
        if id_type is not None:
            yield flushed(id_type)

    return docs.mapInArrow(emit, schema)


def halves(low: int, high: int, content: bytes, s: Settings) -> Iterator[tuple[int, int, int]]:
    """(first window, window after the last, start of the longer common string) of the two parts of a segment.

    ``content[low:high]`` lies in every window. Windows with at least ``half`` free bytes before it have those in common too, the
    others have ``free - half + 1`` behind it.
    """
    free = s.length - (high - low)
    half = (free + 1) // 2
    windows = len(content) - s.length + 1
    cut = min(max(low - half + 1, 0), windows)
    if cut:
        yield 0, cut, low - half
    if cut < windows:
        yield cut, windows, low


def split_segments(rows: DataFrame, s: Settings) -> DataFrame:
    """The parts of segments of hot grams (``n`` is set), and which part lies where in which segment (``p1`` is set)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(s.held)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [*FIELDS, "p1", "p2", "offset"]

        def flushed() -> pa.RecordBatch:
            made = [pa.array(c, t) for c, t in zip(found.taken(), types, strict=True)]
            return pa.RecordBatch.from_arrays([*made, *[pa.nulls(len(made[0]), pa.int64())] * 3], names=names)

        for batch in batches:
            links = []
            for low, high, d1, d2, n, content in zip(*[batch[c].to_pylist() for c in FIELDS[1:]], strict=True):
                free = s.length - (high - low)
                more = (free + 1) // 2
                for a, b, start in halves(low, high, content, s):
                    size = high - low + (more if start < low else free - more + 1)
                    common = content[start : start + size]
                    piece = content[a : b + s.length - 1]
                    gram = xxhash.xxh3_64_intdigest(common, seed=1 + (start < low))
                    key = digest(piece)
                    found.add(gram - 2**63, start - a, start - a + size, key, n, piece)
                    links.append((*key, d1, d2, a))
            columns = list(zip(*links, strict=True)) or [()] * 5
            none = [pa.nulls(len(links), t) for t in types]
            none[3], none[4] = pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())
            yield pa.RecordBatch.from_arrays([*none, *[pa.array(c, pa.int64()) for c in columns[2:]]], names=names)
            if found.size >= s.held:
                yield flushed()
        yield flushed()

    return rows.select(*FIELDS).mapInArrow(emit, f"{SEGMENT}, p1 long, p2 long, offset long")


def scratch_folder() -> str | None:
    """Where Spark itself spills on this executor."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def common_start(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:  # the first ``low`` are equal, the first ``high`` are not
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def longest_shared(strings: list[bytes]) -> list[int]:
    """For each string, the most bytes that its start has in common with any other: with a neighbour in their order."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in itertools.pairwise(order):
        same = common_start(strings[i], strings[j])
        out[i], out[j] = max(out[i], same), same
    return out


def shareable(group: list[list], s: Settings) -> dict[tuple[int, bytes], list[tuple[tuple[int, int], int]]]:
    """The stretches of a gram's segments that others may share, each with (key, first window) of the segments that hold it.

    ``group``: (key, n, content, low) per segment; the gram is at ``low``. A window that begins ``k`` bytes before the gram and
    is also in another segment has ``k`` bytes before and ``length - k`` from the gram in common with that one.
    """
    ahead = longest_shared([content[low:] for _, _, content, low in group])
    behind = longest_shared([content[:low][::-1] for _, _, content, low in group])
    found: dict[tuple[int, bytes], list[tuple[tuple[int, int], int]]] = {}
    for (key, _, content, low), before, after in zip(group, behind, ahead, strict=True):
        if before + after >= s.length:
            found.setdefault((before, content[low - before : low + after]), []).append((key, low - before))
    return found


def shard_spans(rows: Iterator[tuple], s: Settings) -> Iterator[list[tuple[int, int, int, int]]]:
    """(d1, d2, first window, window after the last) of repeated windows. ``rows``: (gram, d1, d2, n, content, low), sorted."""
    keys: list[tuple[int, int]] = []
    firsts: list[int] = []
    known: list[bool] = []  # reported already: such a stretch is sorted for the others only
    lengths: list[int] = []
    with Scratch(scratch_folder(), s.memory) as scratch:
        joined = bytearray()
        path = None

        def add(key: tuple[int, int], first: int, done: bool, content: bytes) -> None:
            keys.append(key)
            firsts.append(first)
            known.append(done)
            lengths.append(len(content) + 1)
            joined.extend(content)
            joined.append(0)

        def keep(group: list[list], whole: bool = True) -> Iterator[list]:
            """``whole``: these are all segments of the gram."""
            nonlocal path
            met = [(*key, 0, len(content) - s.length + 1) for key, n, content, _ in group if n > 1]
            if not whole:
                for key, n, content, _ in group:
                    add(key, 0, n > 1, content)
            elif len(group) > 1:  # else nothing to compare with: equal segments were one row
                often = {key for key, n, *_ in group if n > 1}
                found = shareable(group, s)
                for (_, content), owners in found.items():
                    if len(owners) > 1:
                        met += [(*key, first, first + len(content) - s.length + 1) for key, first in owners if key not in often]
                    if len(found) > 1:
                        key, first = owners[0]
                        add(key, first, len(owners) > 1 or key in often, content)
            if met:
                yield met
            if len(joined) > s.memory // 8:
                path = path or scratch.file()
                with open(path, "ab") as out:
                    out.write(joined)
                joined.clear()

        gram, group, whole = None, [], True
        for g, d1, d2, n, content, low in rows:
            if g != gram:
                yield from keep(group, whole)
                gram, group, whole = g, [], True
            if group and group[-1][0] == (d1, d2):
                group[-1][1] += n
            else:
                group.append([(d1, d2), n, content, low])
                if len(group) > 10_000:  # more will follow in this or the next group: they need not wait
                    head, group, whole = group[:-1], group[-1:], False
                    yield from keep(head, whole)
        yield from keep(group, whole)
        if not keys:
            return
        if path:
            with open(path, "ab") as out:
                out.write(joined)
            raw = np.memmap(path, np.uint8, "r")
        else:
            raw = np.frombuffer(bytes(joined), np.uint8)
        ends = np.cumsum(np.array(lengths, np.int64))
        t = scratch.array(len(raw), np.uint16)
        for a in range(0, len(raw), scratch.block):
            t[a : a + scratch.block] = raw[a : a + scratch.block]
        t += np.uint16(1)
        t[ends - 1] = 0
        repeated = scratch.array(len(raw), bool)
        repeated[:] = False
        before = np.empty(0, np.int32)
        for place, prefix in suffix_order(t, s.length, scratch, s.base):
            same = prefix >= s.length
            repeated[place[same]] = True
            previous = np.append(before if len(before) else place[:1], place[:-1])
            repeated[previous[same]] = True
            before = place[-1:]
        starts = ends - np.array(lengths)
        for i in np.flatnonzero(known).tolist():
            repeated[starts[i] : ends[i]] = False
        steps = np.flatnonzero(np.diff(np.asarray(repeated).view(np.int8), prepend=0, append=0))
        owner = np.searchsorted(ends, steps[0::2], side="right")
        for k in range(0, len(owner), 100_000):
            part = owner[k : k + 100_000]
            first, last = steps[2 * k : 2 * (k + 100_000) : 2], steps[2 * k + 1 : 2 * (k + 100_000) : 2]
            rows_ = zip(part.tolist(), (first - starts[part]).tolist(), (last - starts[part]).tolist(), strict=True)
            yield [(*keys[o], firsts[o] + a, firsts[o] + b) for o, a, b in rows_]


def segment_spans(contents: DataFrame, s: Settings) -> DataFrame:
    """(d1, d2, first, last) of the repeated windows of segments, from the suffixes of each shard."""
    size = contents.agg(F.sum(F.length("content"))).first()[0] or 0
    parts = max(1, -(-size // s.shard))
    columns = ["gram", "d1", "d2", "n", "content", "low"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch[c].to_pylist() for c in columns], strict=True))
        for found in shard_spans(rows, s):
            columns_ = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(columns_, names=["d1", "d2", "first", "last"])

    sharded = contents.select(*columns).repartition(parts, "gram").sortWithinPartitions("gram", "d1", "d2")
    return sharded.mapInArrow(sort, "d1 long, d2 long, first long, last long")


def salted_digests(made: DataFrame, s: Settings) -> DataFrame:
    """(d1, salts): first halves of the digests that many rows share; at most ``salted`` of them, since each has that share of all."""
    counted = made.where("n is not null").select("d1", "n")
    least = max(s.salt, (counted.agg(F.sum("n")).first()[0] or 0) // s.salted)
    found = counted.groupBy("d1").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return settle(found.select("d1", F.floor(F.col("n") / least + 1).cast("long").alias("salts")))


def repeated_spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, mark, spans): the removed bytes of rows that have any, as sorted overlapping (start, end). ``docs``: (doc_id, text, mark)."""
    with small_batches(docs.sparkSession, s.batch):
        return found_spans(docs, s)


def found_spans(docs: DataFrame, s: Settings) -> DataFrame:
    ship(docs.sparkSession)
    frequent = bitmap(settle(frequent_grams(docs, s)), s)
    made = settle(repeated_segments(docs, frequent, s), "zstd")
    forget()
    level, links, done = made.where("n is not null").select(*FIELDS), [], []
    while True:
        room = level.where(F.col("high") - F.col("low") < s.length)
        hot = settle(room.groupBy("gram").agg(F.sum(F.length("content")).alias("size")).where(F.col("size") > s.hot).select("gram"))
        if hot.isEmpty():
            done.append(level)
            break
        marked = level.join(hot.withColumn("hot", F.lit(True)), "gram", "left")
        divide = F.coalesce("hot", F.lit(False)) & (F.col("high") - F.col("low") < s.length)
        done.append(marked.where(~divide).select(*FIELDS))
        parts = settle(split_segments(marked.where(divide).drop("hot"), s))
        links.append(parts.where("n is null").select("d1", "d2", "p1", "p2", "offset").distinct())
        level = parts.where("n is not null").select(*FIELDS)
    contents = done[0]
    for more in done[1:]:
        contents = contents.unionAll(more)
    spans = settle(segment_spans(contents, s))
    for link in reversed(links):  # from parts to what they are parts of
        up = spans.join(link, ["d1", "d2"])
        up = up.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), *[(F.col(c) + F.col("offset")).alias(c) for c in ("first", "last")])
        spans = settle(spans.unionAll(up))
    members = made.where("start is not null").select("d1", "d2", "doc_id", "mark", "start")
    hot = F.broadcast(salted_digests(made, s))
    forget()  # the shuffled contents, which the job before this one may still have held
    salts = F.coalesce("salts", F.lit(1))
    salted = members.join(hot, "d1", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "start"), salts).cast("int")).drop("salts")
    spread = spans.join(hot, "d1", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int")))).drop("salts")
    found = salted.join(spread, ["d1", "d2", "salt"])
    one = F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + s.length - 1).alias("end"))
    return found.select("doc_id", "mark", one.alias("span")).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("span")).alias("spans"))


NAMES = ["n_bytes", "removed", "kept"]


def without_repeats(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, the maximal ``removed`` spans of bytes and the bytes ``kept`` of each whole text."""
    docs = without(docs, NAMES)
    string = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = [F.col(doc_id).alias("doc_id"), F.xxhash64(string).alias("mark")]
    spans = repeated_spans(docs.select(string.alias("text"), *known), s).select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "spans")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *known)  # each text crosses the join once, in its row
    met = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    met = met.select("row", F.coalesce(F.col("row")[text].cast("string"), F.lit("")).alias("text"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw = raw_bytes(text)
                sizes.append(len(raw))
                if not spans.is_valid:
                    removed.append([])
                    kept.append(raw.tobytes())
                    continue
                start, end = (np.asarray(c) for c in spans.values.flatten())
                reach = np.maximum.accumulate(end)
                fresh = np.append(True, start[1:] > reach[:-1])
                first, last = start[fresh], reach[np.append(fresh[1:], True)]
                gone = np.zeros(len(raw) + 1, np.int8)
                gone[first] += 1
                gone[last] -= 1
                removed.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                kept.append(raw[np.cumsum(gone[:-1]) == 0].tobytes())
            columns = [batch["row"], pa.array(sizes, pa.int64()), pa.array(removed, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *NAMES])

    row = met.schema["row"].dataType.simpleString()
    made = met.mapInArrow(cut, f"row {row}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return made.select("row.*", *NAMES)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
