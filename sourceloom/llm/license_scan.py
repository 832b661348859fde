"""License scan: MinHash bands over overlapping windows, exact containment, in DataFrame functions alone.

Words are lower-cased runs of letters and digits; shingles are three words. For every number of
words L that a template has, a text is cut into windows of 2 L words that overlap by L, so any run of
L words lies whole in one of them, and of a run of 1.25 L words (an edited copy) at least nine tenths. A window's
signature is the minimum of ``bands`` hash functions over its shingles, one function a band. A window that holds the
share ``containment`` of the m shingles of a template shares a band with it with probability over 0.999; pairs that
share one are verified: share of the template's shingles in the window and one length L more on both sides.

A place that holds that share has at least one of any ``(1 - containment) m + 1`` shingles of the template. So many
of each template (of one with tells, see below: one shingle of each tell) are its anchors, and only windows with an anchor are made: texts are hashed once, tested against the
anchors, and most end there. The templates (``license_texts``) are constants of the code and are broadcast.

A template is a wording; where a wording serves several licenses or versions, the words that tell them apart must
stand in the place without a gap, and they name the license. Of places that overlap only the best stays.

Cases: null, empty and wordless texts match nothing; texts are read whole; several places of one
template and license in one document are one row, with the place of the best; repeated rows give one match, and so
do rows without an id together; no template or no document gives no row; templates of fewer than
three words are one shingle of all their words.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import settle, table
from sourceloom.llm.license_texts import Template, every

TEMPLATES = every()
#: (license, text) of each template.
NOTICES = tuple((t.license, t.text) for t in TEMPLATES)


@dataclass(frozen=True)
class Settings:
    words: int = 3
    bands: int = 32
    containment: float = 0.8


def words_of(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def shingles(words: str, s: Settings) -> Column:
    """Hash of each run of ``s.words`` words; of all words where there are fewer."""
    parts = lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, s.words)])
    keep = F.greatest(F.size(words) - (s.words - 1), F.least(F.size(words), F.lit(1)))
    return F.slice(F.transform(words, parts), F.lit(1), keep)


def signature(hashes: str, s: Settings) -> Column:
    """Array of one minimum per band."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[least(b) for b in range(s.bands)])


def window_starts(hits: Column, length: int) -> Column:
    """The windows of twice ``length`` words, ``length`` apart, that hold a shingle starting at a hit."""

    def both(p: Column) -> Column:
        nearest = F.floor(p / length).cast("int")
        return F.array((nearest - 1) * length, nearest * length)

    def named(a: Column) -> Column:
        return F.struct(F.lit(length).alias("length"), F.greatest(a, F.lit(0)).alias("start"))

    return F.transform(F.array_distinct(F.flatten(F.transform(hits, both))), named)


def anchors(shingle_list: Column, s: Settings) -> Column:
    """So many shingles of a template that any place with the share ``containment`` has one of them."""
    needed = F.ceil(F.size(shingle_list) * s.containment - 1e-9).cast("int")
    return F.slice(F.array_sort(shingle_list), F.lit(1), F.size(shingle_list) - needed + 1)


def templates(spark: SparkSession, notices: tuple[Template, ...], s: Settings) -> DataFrame:
    """(template, license, length, shingles_t, signature_t, tells_t, anchors_t)."""
    rows = [(i, t.license, t.text, [(x.license, x.phrase, x.also) for x in t.tells]) for i, t in enumerate(notices)]
    kind = "template int, license string, text string, tells array<struct<license:string,phrase:string,also:string>>"
    rows = spark.createDataFrame(rows, kind)
    rows = rows.withColumn("words_", words_of(F.col("text"))).withColumn("length", F.size("words_"))
    rows = rows.where("length > 0").withColumn("shingles_t", F.array_distinct(shingles("words_", s)))

    def runs(phrase: Column) -> Column:
        return F.transform(F.array(words_of(phrase)), lambda w: shingles(w, s))[0]

    def tell(t: Column) -> Column:
        return F.struct(t.license.alias("license"), runs(t.phrase).alias("runs"), runs(t.also).alias("also"))

    return rows.select(
        "template",
        "license",
        "length",
        "shingles_t",
        signature("shingles_t", s).alias("signature_t"),
        F.transform("tells", tell).alias("tells_t"),
    ).withColumn(
        # each place of a template with tells holds one of them whole
        "anchors_t",
        F.when(F.size("tells_t") > 0, F.transform("tells_t", lambda t: t.runs[0])).otherwise(anchors(F.col("shingles_t"), s)),
    )


def run_starts(hashes: Column, runs: Column) -> Column:
    """Where ``runs`` stands in ``hashes`` without a gap."""
    return F.filter(
        F.transform(hashes, lambda h, i: F.when((h == runs[0]) & (F.slice(hashes, i + 1, F.size(runs)) == runs), i)),
        lambda x: x.isNotNull(),
    )


def best_places(found: Column) -> Column:
    """Of places that overlap the one with most shingles; of equal ones the longer tell, then the higher containment."""
    ranked = F.array_sort(
        F.transform(
            found,
            lambda x: F.struct(
                (-x.shared).alias("a"), (-x.told).alias("b"), (-x.containment).alias("c"), x.template.alias("d"), x.first_word.alias("e"), x.alias("x")
            ),
        )
    )

    def add(kept: Column, r: Column) -> Column:
        clash = F.exists(kept, lambda k: (k.first_word <= r.x.last_word) & (r.x.first_word <= k.last_word))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(r.x)))

    return F.aggregate(ranked, F.slice(found, 1, 0), add)


def values(hashes: Iterable[int]) -> str:
    return ", ".join(f"{h}L" for h in sorted(hashes))


def scan(docs: DataFrame, notices: tuple[Template, ...] = TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """(doc_id, license, template, containment, first_word, last_word), one row per document, template and license."""
    spark = docs.sparkSession
    # the templates are constants: what the plan needs of them is made once
    made = templates(spark, notices, s)
    listed = made.collect()
    if not listed:
        empty = "license string, template int, containment double, first_word int, last_word int"
        return docs.select("doc_id").join(spark.createDataFrame([], empty), F.lit(False))
    known = F.broadcast(spark.createDataFrame(listed, made.schema).withColumnRenamed("length", "length_t"))
    by_length: dict[int, set[int]] = {}
    for r in listed:
        by_length.setdefault(r["length"], set()).update(r["anchors_t"])
    wanted = sorted(set().union(*by_length.values()))
    # the unnested one-element array keeps the filter below from being computed on the raw text, word by word
    rows = docs.select("doc_id", F.explode_outer(F.array(words_of(F.col("text")))).alias("words_"))
    rows = rows.withColumn("all_", shingles("words_", s))
    # as text, since each value of isin() is a call to the JVM of its own
    hits = F.expr(f"filter(transform(all_, (h, i) -> CASE WHEN h IN ({values(wanted)}) THEN struct(i, h) END), x -> x IS NOT NULL)")
    # written, since the few rows with a hit are used by many expressions below
    rows = settle(rows.withColumn("hits_", hits).where(F.size("hits_") > 0).drop("words_"))

    def of(length: int) -> Column:
        mine = f"transform(filter(hits_, x -> x.h IN ({values(by_length[length])})), x -> x.i)"
        return window_starts(F.expr(mine), length)

    starts = F.array_distinct(F.concat(*[of(n) for n in sorted(by_length)]))
    windows = rows.select(F.xxhash64("all_").alias("text_"), "doc_id", "all_", F.explode_outer(starts).alias("w"))
    span = F.greatest(F.col("w.length") * 2 - (s.words - 1), F.lit(1))
    windows = windows.select(
        "doc_id", "text_", "w.length", "w.start", "all_", F.slice("all_", F.col("w.start") + 1, span).alias("part_")
    ).where(F.size("part_") > 0)
    windows = windows.withColumn("signature_", signature("part_", s))
    # a value is hashed with its band, so equal values mean the same band
    same = (F.col("length") == F.col("length_t")) & F.arrays_overlap("signature_", "signature_t")
    # verified over the window and its neighbourhood of one length on both sides: edited copies are longer
    wide = F.greatest(F.col("start") - F.col("length"), F.lit(0))
    around = F.slice("all_", wide + 1, F.col("start") - wide + F.col("length") * 3)
    pairs = windows.join(known, same).select(
        "doc_id", "text_", "template", "license", "length", "shingles_t", "tells_t", wide.alias("wide"), around.alias("part_")
    )
    need = F.ceil(F.size("shingles_t") * s.containment - 1e-9)
    pairs = pairs.where(F.size(F.array_intersect("part_", "shingles_t")) >= need)
    # a template with tells has a place around each of them, the others one place
    told = F.flatten(
        F.transform(
            "tells_t",
            lambda t: F.transform(
                run_starts(F.col("part_"), t.runs), lambda i: F.struct(t.license.alias("license"), i.alias("i"), F.size(t.runs).alias("n"), t.also.alias("also"))
            ),
        )
    )
    plain = F.array(F.struct("license", F.lit(None).cast("int").alias("i"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("also")))
    pairs = pairs.withColumn("told_", F.explode_outer(F.when(F.size("tells_t") > 0, told).otherwise(plain))).where("told_ is not null")
    low = F.coalesce(F.greatest(F.col("told_.i") - F.col("length"), F.lit(0)), F.lit(0))
    high = F.coalesce(F.col("told_.i") + F.col("told_.n") + F.col("length"), F.size("part_"))
    pairs = pairs.select(
        "doc_id", "text_", "template", "length", "shingles_t", "told_", (F.col("wide") + low).alias("from_"), F.slice("part_", low + 1, high - low).alias("part_")
    )
    also = (F.size("told_.also") == 0) | (F.size(run_starts(F.col("part_"), F.col("told_.also"))) > 0)
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("part_", "shingles_t"))).where(also & (F.col("shared") >= need))
    # positions are found by a join, since long templates have thousands of shingles
    ours = F.broadcast(known.select(F.col("template").alias("template_t"), F.explode("shingles_t").alias("h_t")))
    pairs = pairs.select(
        "doc_id", "text_", "template", "length", "from_", "shared", (F.col("shared") / F.size("shingles_t")).alias("containment"),
        F.col("told_.license").alias("license"), F.col("told_.n").alias("told"), F.posexplode("part_").alias("at_", "h_"),
    )
    pairs = pairs.join(ours, (F.col("template") == F.col("template_t")) & (F.col("h_") == F.col("h_t")))
    key = ["doc_id", "text_", "template", "license", "length", "from_", "shared", "containment", "told"]
    places = pairs.groupBy(*key).agg(F.min("at_").alias("a"), F.max("at_").alias("b"))
    places = places.select(
        "doc_id",
        "text_",
        F.struct(
            "license",
            "template",
            "shared",
            "told",
            "containment",
            (F.col("from_") + F.col("a")).alias("first_word"),
            (F.col("from_") + F.col("b") + F.least(F.col("length"), F.lit(s.words)) - 1).alias("last_word"),
        ).alias("place"),
    )
    kept = places.groupBy("doc_id", "text_").agg(best_places(F.collect_set("place")).alias("kept_"))
    kept = kept.select("doc_id", F.explode("kept_").alias("k")).select("doc_id", "k.*")
    best = F.min(F.struct((-F.col("containment")).alias("c"), "first_word", "last_word"))
    found = kept.groupBy("doc_id", "license", "template").agg(best.alias("b"))
    return found.select(
        "doc_id", "license", "template", (-F.col("b.c")).alias("containment"), "b.first_word", "b.last_word"
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
