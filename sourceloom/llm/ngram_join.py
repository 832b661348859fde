"""N-gram Jaccard join with token-combination prefixes, and the groups its links form.

A text is the set of its shingles (runs of ``words`` words, hashed to 64 bits); two texts link when
``den * |A and B| >= num * |A or B|``. Texts with equal sets are one node, so copies are never compared.

1. Each node emits the shingles that its prefix can reach: those whose hash lies in the lowest share ``reach``, and
   more in hash order where that is less than its longest prefix. The emissions are grouped by hash range, which
   gives each emitted shingle its number of nodes (df) and drops those of one node only.
2. Order: shingles of the low share by (df, hash), then all others by hash. With t = num / den, linked
   sets share a shingle within their first ``n - ceil(t n) + 1`` (the prefix). Shingles of fewer than ``rare`` nodes are
   rare and indexed one by one. A prefix that reaches a frequent shingle is extended so that linked sets share more shingles
   there than they have others between them: some two shared ones then follow each other in both orders, so
   neighbouring frequent shingles are indexed as pairs. (If linked sets share no rare shingle in
   their prefixes, both hold every rare shingle they have in the prefix, so all they share is frequent.)
3. Every index entry tells how many shingles of its node come before all that the entry can stand for: its own place
   for a single one, the number of rare ones for a pair of frequent ones. Linked sets share so many that none of the two
   can have more than ``n - required overlap`` before, so entries meet only under that condition (and fitting sizes).
   Buckets of pairs with the same nodes are the same, and one of them is kept.
4. Star rounds: in every bucket, nodes are compared with one centre (that with the fewest rare shingles,
   which is the least edited of near copies), not with each other, and links merge groups; a bucket whose nodes are all in
   one group is done. A few rounds with other centres leave little.
5. What is left in a small bucket is compared pair by pair. From buckets of more than ``small`` nodes those nodes go that hold
   more shingles of their own, which no other node of such buckets has, than a link allows. The rest is searched through a
   centre c, one for all buckets of the same near copies: with x the number of shingles that a node has more or less than c, two linked nodes a and b differ in at most
   ``r (|a| + |b|)`` shingles, r = (1 - t) / (1 + t), so they share at least ``(x_a + x_b - r (|a| + |b|)) / 2`` of these
   differences. Where that is not positive, both link with c and are in its group already. So nodes are indexed by their
   differences, rarest first, and only as far as that many shared ones leave room: texts that share a passage, or that were
   edited in different ways, do not meet. Nothing is capped, so every link between groups is found.

Sets are compared exactly, on 64-bit shingle hashes. Groups come from alternating star contraction,
each round written to the shared folder.

Cases: null texts and texts without words have 0 shingles, link with nothing and are their own group; fewer words
than a shingle has make one shingle of the whole sequence; texts are read whole; repeated rows are
copies; null ids never name a group while another id can; an empty table gives an empty result;
columns named like the outputs are replaced, others stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import forget, give_back, mixed, release, settle, ship, small_batches, table

LAST = 2**40  # df of shingles outside the low share: they come last, by hash


@dataclass(frozen=True)
class Settings:
    words: int = 4
    num: int = 85
    den: int = 100
    rare: int = 64
    rounds: int = 3
    small: int = 32  # nodes of a bucket that are compared pair by pair
    range_rows: int = 400_000  # emissions per hash range
    batch: int = 500  # rows that a Python worker gets at once: two sets of a few thousand shingles each
    cache: int = 100_000  # digests that a worker remembers
    block: int = 2**20  # bytes of a text that are hashed at once
    long_word: int = 512  # bytes
    flush: int = 400_000  # emissions that a worker gathers before it hands them on

    @property
    def reach(self) -> float:
        t = self.num / self.den
        return min(1.0, (1 - t) + (1 - t) / t)

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def longest(self, n: int) -> int:
        """At least the length of the extended prefix: unshared of one, plus unshared of both, plus two."""
        return min(n, (self.den - self.num) * n // self.den + (self.den - self.num) * n // self.num + 3)


FACTOR = np.uint64(0x9FB21C651E98DF25)
BASE = np.uint64(0x9E3779B97F4A7C15)
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * FACTOR)  # a number per byte
LETTERS[65:91] = LETTERS[97:123]  # A-Z count as a-z
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


class Powers:
    """Powers of ``BASE`` and of its inverse, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", np.uint64(pow(int(BASE), -1, 2**64)))):
                grown = np.full(2 * n, base)
                grown[0] = 1
                setattr(cls, name, np.multiply.accumulate(grown))
        return cls.up[:n], cls.down[:n]


def word_hashes(raw: np.ndarray, s: Settings) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order; block by block, A-Z as a-z.

    Differences of prefix sums of a polynomial in ``BASE``, so no word becomes an object. Polynomials modulo 2**64 can be
    tricked by words of a thousand bytes and more, so words of over ``long_word`` bytes are hashed by themselves.
    """
    edges = np.flatnonzero(np.diff(SPACES[raw].view(np.int8), prepend=1, append=1))
    first, last = edges[0::2], edges[1::2]
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        # the words that begin within a block; only the last of them may reach beyond it
        start = first[at]
        to = int(np.searchsorted(first, start + s.block))
        end = min(last[to - 1], first[to - 1] + s.long_word)
        up, down = Powers.of(end - start + 1)
        sums = np.zeros(end - start + 1, np.uint64)
        np.cumsum(LETTERS[raw[start:end]] * up[: end - start], out=sums[1:])
        a, b = first[at:to] - start, np.minimum(last[at:to] - start, end - start)
        out[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * FACTOR
        at = to
    for i in np.flatnonzero(last - first > s.long_word).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : last[i]].tobytes().lower(), 1)
    return mixed(out)


def shingles(text: str | None, s: Settings) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; bytes are lower-cased and split as ASCII."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    h = word_hashes(raw, s)
    if not len(h):
        return h
    n = min(s.words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * FACTOR + h[k : len(h) - n + 1 + k]
    out = mixed(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def node_of(found: np.ndarray) -> int:
    """A digest of a set, as a signed 64-bit number."""
    return int(np.add.reduce(mixed(found ^ FACTOR)).astype(np.int64)) if len(found) else 0


def low_end(s: Settings) -> np.uint64:
    return np.uint64(min(int(s.reach * 2**64), 2**64 - 1))


MADE = ["doc_id", "n", "node", "low", "range", "tokens", "nodes"]


def measured(docs: DataFrame, s: Settings) -> DataFrame:
    """In one pass over the texts: (doc_id, n, node, low) per row, its set's size and digest and the emitted shingles of the low share,
    and (range, tokens, nodes) where ``range`` is set: emissions by hash range."""
    ship(docs.sparkSession)
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = 1 << max(4, math.ceil(math.log2(max(1, letters / 6 / s.range_rows))))  # about six letters are a word and its space
    shift = np.uint64(64 - int(math.log2(ranges)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        end = low_end(s)
        held: list[tuple[np.ndarray, int]] = []
        seen: set[int] = set()
        rows, id_type = 0, None

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in held])
            nodes = np.repeat(np.array([n for _, n in held], np.int64), [len(t) for t, _ in held])
            order = np.argsort(tokens, kind="stable")
            tokens, nodes = tokens[order], nodes[order]
            places = (tokens >> shift).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(places, prepend=-1)), len(places))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            none = [pa.nulls(len(spans), t) for t in (id_type, *[pa.int64()] * 3)]
            blobs = [
                pa.array(places[cuts[:-1]]),
                pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([nodes[a:b].tobytes() for a, b in spans], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays([*none, *blobs], names=MADE)

        for batch in batches:
            id_type = batch["doc_id"].type
            sizes = []
            for text in batch["text"]:
                found = shingles(text.as_py(), s)
                node, low = node_of(found), int(np.searchsorted(found, end))
                sizes.append((len(found), node, low))
                if not len(found) or node in seen:
                    continue
                if len(seen) < s.cache:
                    seen.add(node)  # copies in one task; others meet in the range
                take = min(max(low, s.longest(len(found))), len(found))
                held.append((found[:take].copy(), node))
                rows += take
                if rows >= s.flush:
                    yield flush()
                    held, rows = [], 0
            columns = [pa.array(c) for c in np.array(sizes, np.int64).reshape(-1, 3).T]
            none = [pa.nulls(len(sizes), t) for t in (pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, *none], names=MADE)
        if held:
            yield flush()
        held = []
        give_back()

    schema = f"doc_id {kind}, n long, node long, low long, range long, tokens binary, nodes binary"
    return docs.select("doc_id", "text").mapInArrow(emit, schema)


def common_shingles(blobs: DataFrame, s: Settings) -> DataFrame:
    """(node, df, token) of emitted shingles that at least two nodes emit. ``blobs``: (range, tokens, nodes)."""

    def count(group: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in group["tokens"]])
        nodes = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in group["nodes"]])
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        del order
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        tokens, nodes = tokens[fresh], nodes[fresh]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        size = np.diff(np.append(start, len(tokens)))
        df = np.repeat(size, size)
        keep = df >= 2
        df = np.where(tokens >= low_end(s), LAST, df)[keep]
        found = pa.table({"node": nodes[keep], "df": df, "token": tokens[keep].view(np.int64)})
        del tokens, nodes, fresh, df, keep, size
        give_back()
        return found

    return blobs.groupBy("range").applyInArrow(count, "node long, df long, token long")


def index(common: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(key, pair, node, n, before): every bucket a node stands in. ``nodes``: (node, n, low)."""
    listed = common.groupBy("node").agg(
        F.collect_list(F.struct("df", F.col("token").bitwiseXOR(F.lit(-(2**63))).alias("place"))).alias("all")
    )
    n, t = F.col("n"), F.col("all")
    prefix = n - F.ceil(n * s.num / F.lit(float(s.den)) - 1e-9) + 1
    longest = F.floor(n * (s.den - s.num) / s.den) + F.floor(n * (s.den - s.num) / s.num) + 3
    rows = listed.join(nodes, "node").select("node", "n", "low", F.sort_array("all").alias("all"))
    alone = F.col("low") - F.size(F.filter(t, lambda x: x["df"] < LAST))  # of this node only: they come first
    rows = rows.withColumn("alone", alone.cast("int"))
    rows = rows.withColumns({"head": (prefix - F.col("alone")).cast("int"), "reached": (longest - F.col("alone")).cast("int")})
    rows = rows.where("head > 0").withColumn("first", F.slice("all", F.lit(1), F.col("head")))
    rows = rows.withColumn("rare", F.col("alone") + F.size(F.filter(t, lambda x: x["df"] < s.rare)))
    rows = rows.withColumn(
        "tail",
        F.when(
            F.exists("first", lambda x: x["df"] >= s.rare),
            F.filter(F.slice("all", F.lit(1), F.col("reached")), lambda x: x["df"] >= s.rare),
        ).otherwise(F.expr("array()").cast(rows.schema["all"].dataType)),
    )

    def entry(key, pair: bool, before) -> Column:
        return F.struct(key.alias("key"), F.lit(pair).alias("pair"), before.cast("int").alias("before"))

    single = F.transform(
        F.filter("first", lambda x: x["df"] < s.rare),  # rare ones come first, so places count on
        lambda x, i: entry(F.xxhash64(F.lit(1), x["place"]), False, F.col("alone") + i),
    )
    pairs = F.transform(
        F.slice("tail", F.lit(2), F.greatest(F.size("tail") - 1, F.lit(0))),
        lambda x, i: entry(F.xxhash64(F.lit(2), F.get("tail", i)["place"], x["place"]), True, F.col("rare")),
    )
    return rows.select(F.explode(F.concat(single, pairs)).alias("e"), "node", "n").select("e.*", "node", "n")


def shared_buckets(postings: DataFrame) -> DataFrame:
    """Postings of buckets with several nodes; of pair buckets with the same nodes only one."""
    sizes = postings.groupBy("key", "pair").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum(F.xxhash64("node") % F.lit(2**40)).alias("one"), F.sum(F.xxhash64("node", F.lit(1)) % F.lit(2**40)).alias("two")
    )
    sizes = sizes.where("nodes > 1")
    pairs = sizes.where("pair").groupBy("nodes", "one", "two").agg(F.min("key").alias("key")).select("key")
    return postings.join(sizes.where("not pair").select("key").unionAll(pairs), "key", "left_semi").drop("pair")


def fitting(a: str, b: str, before_a: str, before_b: str, s: Settings) -> Column:
    """Sizes and places that allow a link."""
    a, b = F.col(a), F.col(b)
    need = (a + b) * s.num
    return (
        (F.least(a, b) * s.den >= F.greatest(a, b) * s.num)
        & ((a - F.col(before_a)) * (s.num + s.den) >= need)
        & ((b - F.col(before_b)) * (s.num + s.den) >= need)
    )


def likely(rows: DataFrame, column: str, wanted: DataFrame, *ids: str) -> DataFrame:
    """Rows whose ``column`` may be among ``ids`` of ``wanted``, by a bitmap of 2**25 hashed numbers: bounded, and it loses none.

    It spares a shuffle of all wide rows before the exact join; where it fills up it merely passes more.
    """
    hashed = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(2**25)) + 1
    bits = wanted.select(F.explode(F.array(*[hashed(c) for c in ids])).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )  # at most 1,024 rows of 4 KB; Spark's buckets count from 1
    at = F.bitmap_bit_position(hashed(column)).cast("int")
    byte = F.conv(F.hex(F.substr("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(parts), F.bitmap_bucket_number(hashed(column)) == F.col("bucket"))
    return found.where(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1).drop("bucket", "bits")


def linked(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The ``pairs`` (a, b and what else they hold) whose sets link, by exact comparison."""
    pairs = settle(pairs)
    held = likely(sets, "node", pairs, "a", "b")
    one = held.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    two = held.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    met = pairs.join(one, "a").join(two, "b")
    return met.where(both * (s.num + s.den) >= (F.size("tokens_a") + F.size("tokens_b")) * s.num).select(*pairs.columns)


def noted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` settled, and their number and a sum of hashes, taken while they are written."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b") % F.lit(2**40)).alias("total")
    out = settle(edges.observe(seen, F.count(F.lit(1)).alias("rows"), total))
    found = seen.get
    return out, (found.get("rows") or 0, found.get("total"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node that has an edge (a, b)."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges, state = noted(edges.distinct())
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old, before = edges, state
        edges, state = noted(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        release(old)
        if state == before:  # a round changes nothing only where each node hangs on the smallest one
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def placed(postings: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Postings with the ``label`` of their node, of the buckets that hold more than one label."""
    if groups is None:
        rows = postings.withColumn("label", F.col("node"))
    else:
        rows = postings.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_keys = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    return rows.join(mixed_keys, "key", "left_semi").select("key", "node", "n", "before", "label")


def star(rows: DataFrame, turn: int, s: Settings) -> DataFrame:
    """Pairs of each bucket's centre with its nodes of other labels; each turn has another centre."""
    rank = F.col("before") if turn < 2 else F.lit(0)
    place = F.struct(rank.alias("rank"), F.xxhash64(F.lit(turn), "node").alias("hash"), "node", "n", "before", "label")
    centre = rows.groupBy("key").agg(F.min(place).alias("c")).select(
        "key", *[F.col(f"c.{x}").alias(f"{x}_c") for x in ("node", "n", "before", "label")]
    )
    met = rows.join(centre, "key").where((F.col("label") != F.col("label_c")) & fitting("n", "n_c", "before", "before_c", s))
    return pairs_of(met, ("node", "label"), ("node_c", "label_c"))


def sided(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in keys])


def pairs_of(met: DataFrame, one=("node_a", "label_a"), two=("node_b", "label_b")) -> DataFrame:
    """Distinct (a, b, label_a, label_b), the smaller node first."""
    ends = [F.struct(F.col(node).alias("node"), F.col(label).alias("label")) for node, label in (one, two)]
    met = met.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    return met.select(*[F.col(f"{x}.node").alias(x) for x in "ab"], *[F.col(f"{x}.label").alias(f"label_{x}") for x in "ab"]).distinct()


def within_small(rows: DataFrame, s: Settings) -> DataFrame:
    """All pairs of nodes of different labels that share a small bucket and fit."""
    met = sided(rows, ["key"], "a").join(sided(rows, ["key"], "b"), "key").where(F.col("label_a") < F.col("label_b"))
    return pairs_of(met.where(fitting("n_a", "n_b", "before_a", "before_b", s)))


def able(large: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(node, tokens) of the nodes of large buckets that can link with another one there.

    A set shares at least the share t of its shingles with any set it links with, so one that holds more than the others
    leave to it, shingles that no other node of a large bucket has, links with none of them.
    """
    nodes = large.select("node").distinct()
    own = settle(likely(sets, "node", nodes, "node").join(nodes, "node", "left_semi"))
    df = own.select("node", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.min("node").alias("node")
    )
    alone = df.where("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    shared = F.size("tokens") - F.coalesce("alone", F.lit(0))
    return settle(own.join(alone, "node", "left").where(shared * s.den >= F.size("tokens") * s.num).select("node", "tokens"))


def centred(large: DataFrame, sets: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, n, label, centre, n_c, label_c): nodes of large buckets with their buckets' centres, and with the centres
    that stand for these.

    Buckets of the same near copies have different centres. Any node may be the centre of a bucket, so of centres that share
    a bucket and half of their shingles the one with most nodes stands for the others: a node then meets it once.
    """
    place = F.struct("before", F.xxhash64("node").alias("hash"), "node", "n", "label")
    centre = large.groupBy("key").agg(F.min(place).alias("c")).select(
        "key", F.col("c.node").alias("centre"), F.col("c.n").alias("n_c"), F.col("c.label").alias("label_c")
    )
    around = settle(large.join(centre, "key").select("node", "n", "label", "centre", "n_c", "label_c").distinct())
    met = around.groupBy("centre", "n_c", "label_c").agg(F.count(F.lit(1)).alias("met"))
    met = settle(met.select("centre", F.struct((-F.col("met")).alias("rank"), "centre", "n_c", "label_c").alias("c")))
    ends = around.select("centre", "node").join(met.select(F.col("centre").alias("node")), "node").where("centre <> node")
    ends = ends.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    close = linked(ends, sets, replace(s, num=1, den=2))
    close = close.unionAll(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    better = close.join(met.select(F.col("centre").alias("b"), "c"), "b").select(F.col("a").alias("centre"), "c")
    best = settle(better.unionAll(met).groupBy("centre").agg(F.min("c").alias("c")))
    names = best.select(F.col("centre").alias("old"), F.col("c").alias("new"))
    best = best.join(names, F.col("c.centre") == F.col("old")).select("centre", F.col("new").alias("c"))  # and what stands for that one
    named = around.drop("n_c", "label_c").join(best, "centre").select(
        "node", "n", "label", F.col("c.centre").alias("centre"), F.col("c.n_c").alias("n_c"), F.col("c.label_c").alias("label_c")
    )
    return around, settle(named.distinct())


def unpacked(sets: DataFrame) -> DataFrame:
    """Sets (node, tokens) with arrays of shingles, also where they come as bytes."""
    if sets.schema["tokens"].dataType.simpleString() != "binary":
        return sets

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array([np.frombuffer(t.as_buffer(), np.int64) for t in batch["tokens"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["node"], tokens], names=["node", "tokens"])

    return sets.select("node", "tokens").mapInArrow(unpack, "node long, tokens array<long>")


def differences(around: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(centre, token, node, n, n_c, label, x, i) per shingle that a node has more or less than its centre, ``i``: its rank, rarest first.

    Shingles of one node only come first and meet nothing, and ranks beyond those that pairs may meet at are of no use: neither is a row.
    """
    sets = unpacked(sets)
    own = sets.select("node", F.col("tokens").alias("own"))
    theirs = likely(sets, "node", around, "centre").select(F.col("node").alias("centre"), F.col("tokens").alias("theirs"))
    rows = around.join(own, "node").join(theirs, "centre")
    rows = rows.withColumn("d", F.concat(F.array_except("own", "theirs"), F.array_except("theirs", "own"))).drop("own", "theirs")
    rows = settle(rows.select("centre", "node", "n", "n_c", "label", F.size("d").alias("x"), F.explode("d").alias("token")))
    counts = rows.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = rows.join(counts, ["centre", "token"]).groupBy("centre", "node").agg(
        *[F.first(c).alias(c) for c in ("n", "n_c", "label", "x")], F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all")
    )
    ranked = ranked.withColumn("alone", F.col("x") - F.size("all"))
    wanted = F.floor(deepest(s)).cast("int") + 1 - F.col("alone")
    met = ranked.withColumn("all", F.slice("all", F.lit(1), F.greatest(wanted, F.lit(0))))
    met = met.select("centre", "node", "n", "n_c", "label", "x", "alone", F.posexplode("all.token").alias("at", "token"))
    return met.withColumn("i", F.col("at") + F.col("alone")).drop("at", "alone")


def deepest(s: Settings) -> Column:
    """The rank up to which a shared difference of the one with more differences is looked for."""
    return (F.col("x") + F.col("n") * (1 + s.den / s.num) * (s.den - s.num) / (s.den + s.num)) / 2 + 1e-6


def across_centre(around: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs of nodes of different labels that can link although not both link with their centre."""
    rate = (s.den - s.num) / (s.den + s.num)
    more = settle(differences(around, sets, s))
    # the one with fewer differences needs its rarer half: the other, or itself, does not link with the centre
    room = F.greatest(F.col("n") * (s.den / s.num) - F.col("n_c"), F.lit(0.0)) * rate
    fewer = more.where(F.col("i") <= (F.col("x") + room) / 2 + 1e-6)
    keys = ["centre", "token"]
    met = sided(fewer.drop("n_c"), keys, "a").join(sided(more.drop("n_c"), keys, "b"), keys)
    differ = (F.col("n_a") + F.col("n_b")) * rate
    met = met.where(
        (F.col("label_a") != F.col("label_b"))
        & (F.struct("x_a", "node_a") < F.struct("x_b", "node_b"))
        & (F.least("n_a", "n_b") * s.den >= F.greatest("n_a", "n_b") * s.num)
        & (2 * F.col("i_a") <= F.col("x_a") - F.col("x_b") + differ + 1e-6)
        & (2 * F.col("i_b") <= F.col("x_b") - F.col("x_a") + differ + 1e-6)
    )
    return pairs_of(met)


def remaining(postings: DataFrame, groups: DataFrame | None, sets: DataFrame, s: Settings) -> DataFrame:
    """The groups, once all pairs that the stars left are found: ``postings`` as in ``placed``."""

    def of_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of small and of large buckets, of those that hold more than one label."""
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.min("label").alias("l"), F.max("label").alias("h"))
        sizes = sizes.where("l <> h")
        few = F.col("nodes") <= s.small
        return tuple(rows.join(sizes.where(w).select("key"), "key", "left_semi") for w in (few, ~few))

    rows = settle(placed(postings, groups))
    small, large = of_size(rows)
    able_sets = able(large, sets, s)
    fewer, large = of_size(settle(large.join(able_sets.select("node"), "node", "left_semi")))
    around, named = centred(large, able_sets, s)
    near = around.unionByName(named).where(
        (F.col("label") != F.col("label_c")) & (F.least("n", "n_c") * s.den >= F.greatest("n", "n_c") * s.num)
    )
    near = settle(pairs_of(near, ("node", "label"), ("centre", "label_c")))
    pairs = within_small(small.unionByName(settle(fewer)), s).unionAll(near)
    groups = merged(groups, linked(pairs, sets, s))
    release(rows)
    if not named.isEmpty():
        named = named.drop("label", "label_c").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = named.groupBy("centre").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("centre")
        named = settle(named.join(several, "centre", "left_semi"))
        groups = merged(groups, linked(across_centre(named, able_sets, s), able_sets, s))
    return groups


def merged(groups: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The groups that new edges, between the labels of the groups before, make of these."""
    found = components(edges.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    if groups is not None:
        new = found.select(F.col("node").alias("label"), F.col("label").alias("least"))
        moved = groups.join(new, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
        found = settle(moved.unionAll(found))
    forget()
    return found


def grouped(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    with small_batches(docs.sparkSession, s.batch):
        return joined(docs, s)


def joined(docs: DataFrame, s: Settings) -> DataFrame:
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = settle(measured(base, s))
    info = settle(made.where("n is not null").select("doc_id", "n", "node", "low"))
    nodes = info.where("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.first("low").alias("low"), F.min("doc_id").alias("rep")
    )
    nodes = settle(nodes)
    found = settle(common_shingles(made.where("range is not null").select("range", "tokens", "nodes"), s))
    release(made)
    forget()
    entries = settle(index(found, nodes.select("node", "n", "low"), s))
    postings = settle(shared_buckets(entries))
    release(found, entries)
    wanted = settle(postings.select("node").distinct().join(nodes.select("node", "rep"), "node"))
    texts = likely(base, "doc_id", wanted, "rep").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text"])  # repeated rows, where the join has left them

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            made = [shingles(t.as_py(), s) for t in batch["text"]]
            edges = np.append(0, np.cumsum([len(m) for m in made])).astype(np.int32)
            values = pa.array(np.concatenate([*made, np.empty(0, np.uint64)]).view(np.int64))
            columns = [pa.array([node_of(m) for m in made], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), values)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "tokens"])

    sets = settle(texts.select("text").mapInArrow(tokens, "node long, tokens array<long>"))
    forget()
    groups: DataFrame | None = None
    for turn in range(s.rounds):
        rows = settle(placed(postings, groups))
        before, groups = groups, merged(groups, linked(star(rows, turn, s), sets, s))
        release(rows, before)
    groups = remaining(postings, groups, sets, s)
    release(postings, sets)
    labelled = nodes.select("node", "rep").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = settle(labelled.join(least, "label").select("node", "component_id"))
    full = info.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = info.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionAll(bare)


def representatives(docs: DataFrame, s: Settings) -> DataFrame:
    """Rows of ``docs`` that stand for their group: those whose id names it.

    Rows of equal ids count as one document; rows without an id name nothing and all stay.
    """
    kept = grouped(docs, s).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, F.col("doc_id") == F.col("kept_id")).drop("kept_id").dropDuplicates(["doc_id"])
    return rows.unionAll(docs.where("doc_id is null"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
