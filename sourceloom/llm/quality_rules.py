"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Base rules come from the words of a text: counts, symbols, repeated lines and repeated three-word
windows. The ratio then judges what passes: tokens (words, and runs of ASCII punctuation apart; a
token equal to the one before is a repeat mark) give unigrams and bigrams, hashed to ``buckets``
cells. Two multinomials over the cells are counted, one on trusted texts, one on every document of
the corpus; a text's score is the mean over its n-grams of the log ratio of the smoothed
probabilities. A document is kept if its score is not below ``lower quartile - fence * interquartile
range`` of the trusted scores, which is the same threshold for every document.

Trusted texts are all labelled good ones, and raw counts cover all documents; nothing is sampled. Each document is
handled in its own row, once: its base columns and the cells of its n-grams are written, counted and judged from
there. Only ids, numbered rows and cell counts (at most ``buckets`` rows a task) are shuffled: which rows are trusted goes back to
them as bitmaps, one bit a document. The quartiles are exact: scores are counted by value, then summed up by narrow bins.

Cases: null and empty texts have no words and fail the base rules; texts of any length are
read whole; windows are compared by 64-bit hashes; repeated rows are judged alike; a score equal to the threshold is
kept; without a trusted text the ratio keeps all that pass the base rules; an empty table gives an empty result; only
``doc_id`` and ``text`` of a table are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourceloom.llm.common import release, settle, table

BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    smoothing: float = 1.0
    fence: float = 4.0
    bins: int = 1000  # of the trusted scores, per unit
    min_words: int = 50
    max_repeat_percent: int = 50


def split_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def base(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"words_": split_words(text), "body_": text})
    lines = F.filter(F.split("body_", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    rows = rows.withColumns(
        {
            "n_words": F.size("words_").cast("long"),
            "word_chars": F.length(F.translate("body_", BLANKS, "")).cast("long"),
            "n_symbols": (F.length("body_") - F.length(F.translate("body_", "#*$%&|<>", ""))).cast("long"),
            "lines_": lines,
            "keys_": F.slice(
                F.transform("words_", lambda x, i: F.xxhash64(x, F.get("words_", i + 1), F.get("words_", i + 2))),
                F.lit(1),
                F.greatest(F.size("words_") - 2, F.lit(0)),
            ),
        }
    )
    # Low bits of a hash and a place in one number: a primitive sort brings equal windows together. Blocks of equal
    # low bits hold all repeats; these few are then compared by the whole hash.
    repeated = F.size(F.array_distinct("keys_")) < F.size("keys_")
    rows = rows.withColumn("bits_", F.length(F.bin(F.size("keys_"))))  # every place fits, whatever the length
    packed = F.transform("keys_", lambda k, i: F.call_function("shiftleft", k, F.col("bits_")).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("sorted_", F.when(repeated, F.sort_array(packed)).otherwise(F.expr("cast(array() as array<bigint>)")))

    def near(a: Column, b: Column) -> Column:
        return F.coalesce(F.call_function("shiftright", a.bitwiseXOR(b), F.col("bits_")) == 0, F.lit(False))

    blocks = F.filter("sorted_", lambda x, i: near(x, F.get("sorted_", i + 1)) | near(x, F.get("sorted_", i - 1)))
    place = lambda x: x.bitwiseAND(F.expr("shiftleft(1L, bits_) - 1")).cast("int")
    rows = rows.withColumn("blocks_", blocks).withColumn(
        "exact_", F.sort_array(F.transform("blocks_", lambda x: F.struct(F.get("keys_", place(x)).alias("k"), place(x).alias("p"))))
    )
    twice = F.filter(
        "exact_",
        lambda x, i: F.coalesce(x["k"] == F.get("exact_", i + 1)["k"], F.lit(False))
        | F.coalesce(x["k"] == F.get("exact_", i - 1)["k"], F.lit(False)),
    )
    rows = rows.withColumn("twice_", twice).withColumn("places_", F.sort_array(F.transform("twice_", lambda x: x["p"])))
    covered = F.transform("places_", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places_", i + 1) - p, F.lit(3))))
    rows = rows.withColumns(
        {
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
        }
    )
    failed = (F.col("n_words") < s.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * s.max_repeat_percent)
    made = ("words_", "body_", "lines_", "keys_", "bits_", "sorted_", "blocks_", "exact_", "twice_", "places_")
    return rows.withColumn("base_failed", failed).drop(*made)


def grams(docs: DataFrame, s: Settings) -> DataFrame:
    """``docs`` with ``grams_``: cells of its unigrams and bigrams."""
    apart = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"([!-/:-@\[-`{-~]+)", " $1 ")
    rows = docs.withColumn("raw_", split_words(apart))
    hashed = F.transform("raw_", lambda x, i: F.when((i > 0) & (x == F.get("raw_", i - 1)), F.lit(0)).otherwise(F.xxhash64(x)))
    rows = rows.withColumn("hash_", hashed)
    singles = F.transform("hash_", lambda h: F.pmod(h, F.lit(s.buckets)).cast("int"))
    pairs = F.transform(
        F.slice("hash_", F.lit(2), F.greatest(F.size("hash_") - 1, F.lit(0))),
        lambda h, i: F.pmod(h.bitwiseXOR(F.shiftleft(F.get("hash_", i), 7)), F.lit(s.buckets)).cast("int"),
    )
    return rows.withColumn("grams_", F.concat(singles, pairs)).drop("raw_", "hash_")


def flagged(numbered: DataFrame, trusted: DataFrame) -> DataFrame:
    """``numbered`` (a written table with ``at_``, numbers of its rows) with ``good_``: 1 for rows with a trusted id, else null.

    The wide rows are not shuffled: bitmaps of 32,768 row numbers are looked up by each of them.
    """
    number = F.col("at_") + 1  # Spark's buckets and bits count from 1
    found = numbered.select("doc_id", "at_").join(trusted, "doc_id", "left_semi")
    bitmaps = found.groupBy(F.bitmap_bucket_number(number).alias("part_")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits_")
    )
    rows = numbered.withColumns({"part_": F.bitmap_bucket_number(number), "bit_": F.bitmap_bit_position(number)})
    rows = rows.join(F.broadcast(bitmaps), "part_", "left")  # one bit a row
    byte = F.substr("bits_", F.shiftright("bit_", 3).cast("int") + 1, F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod("bit_", F.lit(8)).cast("int"))
    return rows.withColumn("good_", F.when(bit.bitwiseAND(F.lit(1)) == 1, F.lit(1))).drop("part_", "bit_", "bits_")


def ratios(celled: DataFrame, trusted: DataFrame, s: Settings) -> DataFrame:
    """One row: ``weights_``, the log ratio of every cell. ``celled`` has doc_id and ``grams_``; ``trusted``: distinct
    ids."""
    if "at_" not in celled.columns:
        celled = settle(celled.select("doc_id", "grams_").withColumn("at_", F.monotonically_increasing_id()))
    marked = flagged(celled.select("doc_id", "grams_", "at_"), trusted)
    # the outer form, since the inner one makes the optimiser compute the array once more to test its size
    cells = marked.select(F.col("good_"), F.explode_outer("grams_").alias("cell")).where("cell is not null")
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.count("good_").alias("good"))
    full = celled.sparkSession.range(s.buckets).withColumnRenamed("id", "cell").join(counts, "cell", "left").na.fill(0)
    listed = full.agg(
        F.sort_array(F.collect_list(F.struct("cell", "raw", "good"))).alias("c"), F.sum("raw").alias("r"), F.sum("good").alias("g")
    )
    a, n = s.smoothing, s.smoothing * s.buckets
    weight = lambda x: F.log((x["good"] + a) / (F.col("g") + n)) - F.log((x["raw"] + a) / (F.col("r") + n))
    return listed.select(F.transform("c", weight).alias("weights_"))


def quartiles(scores: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row: ``low`` and ``high``, the exact interpolated quartiles of ``score``; nulls without any.

    Equal scores are one row, and running counts are made bin by bin, so that no task holds all of them.
    """
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("score") * s.bins))
    bins = counts.groupBy("bin").agg(F.sum("n").alias("rows"))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a score is a mean of log ratios: few bins
    starts = bins.select("bin", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("bin").orderBy("score")
    placed = counts.join(F.broadcast(starts), "bin").withColumn("end", F.col("start") + F.sum("n").over(within))
    last = bins.agg(F.sum("rows")).scalar() - 1
    row = placed.agg(
        *[F.min(F.when(F.col("end") > f(last * q), F.col("score"))).alias(c) for c, f, q in (
            ("a", F.floor, 0.25), ("b", F.ceil, 0.25), ("c", F.floor, 0.75), ("d", F.ceil, 0.75))]
    )
    between = lambda a, b, q: F.col(a) + (last * q - F.floor(last * q)) * (F.col(b) - F.col(a))
    return row.select(between("a", "b", 0.25).alias("low"), between("c", "d", 0.75).alias("high"))


def judged(docs: DataFrame, trusted: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, the base columns, ``score`` and ``kept``; ``trusted``: the ids of the trusted texts."""
    trusted = settle(trusted.select("doc_id").distinct())
    celled = settle(base(grams(docs.select("doc_id", "text"), s), s).drop("text").withColumn("at_", F.monotonically_increasing_id()), "zstd")
    weights = settle(ratios(celled, trusted, s)).select("weights_").scalar()
    rows = celled.withColumn("weights_", weights)
    total = F.aggregate("grams_", F.lit(0.0), lambda a, b: a + F.get("weights_", b))
    scored = rows.withColumn("score", F.when(F.size("grams_") > 0, total / F.size("grams_")).otherwise(0.0))
    scored = settle(scored.drop("grams_", "weights_", "at_"))
    release(celled)
    found = settle(quartiles(scored.where("not base_failed").join(trusted, "doc_id").select("score"), s))
    lowest = found.select(F.col("low") - (F.col("high") - F.col("low")) * s.fence).scalar()
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= lowest, F.lit(True)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
