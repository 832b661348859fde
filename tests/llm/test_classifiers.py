"""Language ID, toxicity, quality classifier and quality rules: held-out labels, plain counts, odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import language_id, quality_classifier, quality_rules, toxicity
from tests.llm.plain import base_rules

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, SCORE_2 string"
ODD = [
    (1, None, None, 1.0, "x"),
    (2, "", "en", 1.0, "x"),
    (3, "  \t\n ", None, None, None),
    (4, "1234 !! 5", "en", 0.0, ""),
    (5, "word " * 30000, "en", 0.0, ""),
    (5, "word " * 30000, "en", 0.0, ""),
    (None, "no id here", None, None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def label_of(module) -> str:
    return "quality" if module is quality_classifier else "toxic"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_of_held_out_texts(spark, tables):
    truth = {r["doc_id"]: r["lang"] for r in tables[0].select("doc_id", "lang").collect()}
    held = [r for r in language_id.op1_language_id(spark, SF).collect() if r["held_out"]]
    assert len(held) > 200
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_of_odd_rows(spark, tables, odd):
    model = language_id.fit(tables[0].limit(300))
    got = language_id.predict(odd.withColumnRenamed("score", "Lang_Pred"), model)
    assert got.columns == ["doc_id", "text", "lang", "SCORE_2", "lang_pred", "score", "rejected"]
    rows = by_id(got)
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert rows[5]["lang_pred"] != "und" and got.count() == len(ODD)
    assert language_id.fit(odd.where("false")) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    one = language_id.fit(odd.where("doc_id = 5"))
    assert by_id(language_id.predict(odd, one))[5]["lang_pred"] == "en"


def test_subwords_equal_plain_subwords():
    """Slices of any size give the grams of every word and none across words; equal grams share a bucket."""
    words = ["a", "bcd", "\u00e9\U0001f600", "a" * 40, "bcd"]
    plain = [g[i : i + n] for g in (f"<{w}>" for w in words) for n in (1, 2, 3) for i in range(len(g) - n + 1)]
    whole = np.sort(np.concatenate(list(language_id.buckets(words, language_id.Settings()))))
    assert len(whole) == len(plain) and len(np.unique(whole)) == len(set(plain))
    for size in (1, 2, 3, 7):
        cut = np.concatenate(list(language_id.buckets(words, language_id.Settings(slice_chars=size))))
        assert np.array_equal(np.sort(cut), whole)
    assert list(language_id.buckets([], language_id.Settings())) == []


def test_calibration_reads_no_learned_text(monkeypatch, spark, tables):
    seen = {}

    def caught(rows, y, held, languages, s):
        seen.update(learn={r[0].tobytes() + r[1].tobytes() for r, h in zip(rows, held) if not h}, held=held, rows=rows)
        return "model"

    monkeypatch.setattr(language_id, "fit_sgd", caught)
    docs = tables[0].where("doc_id < 400").unionByName(tables[0].where("doc_id < 400").withColumn("doc_id", tables[0].doc_id + 10**6))
    assert language_id.fit(docs, settings=language_id.Settings(pieces=0)) == "model"
    kept = [r for r, h in zip(seen["rows"], seen["held"]) if h]
    assert len(kept) > 20 and not any(r[0].tobytes() + r[1].tobytes() in seen["learn"] for r in kept)


def test_confidence_at_the_threshold_is_accepted():
    s = language_id.Settings(bits=4)
    rows = [(np.array([i % 2]), np.array([1.0], np.float32)) for i in range(64)]
    held = np.arange(64) % 4 == 0
    model = language_id.fit_sgd(rows, np.arange(64) % 2, held, ["a", "b"], s)
    sure = model.probabilities(np.array([model.logits[0]], np.float64)).max()
    assert model.threshold <= sure + 1e-12


def test_long_text_counts_whole(spark, tables):
    model = language_id.fit(tables[0].limit(400))
    mostly = "der die und nicht ist " * 20 + "the of and to is " * 4000
    rows = spark.createDataFrame([(1, mostly)], "doc_id long, text string")
    assert language_id.predict(rows, model).first()["lang_pred"] == "en"


@pytest.mark.parametrize("module, label, share", [(quality_classifier, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_labels(spark, tables, module, label, share):
    query = {"quality": quality_classifier.op10_quality_classifier, "toxic": toxicity.op4_toxicity}[label]
    truth = {r["doc_id"]: r[label] for r in tables[1].collect()}
    held = [r for r in query(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > share


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_scores_of_odd_rows(spark, tables, odd, module):
    labels = tables[1].select("doc_id", label_of(module)).unionByName(spark.createDataFrame([(None, None), (5, 1)], f"doc_id long, {label_of(module)} long"))
    got = module.judged(tables[0].select("doc_id", "text").limit(300).unionByName(odd.select("doc_id", "text")), labels)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got.collect())
    rows = odd.withColumnRenamed("SCORE_2", "predicted")
    empty = module.judged(rows, tables[1].where("false"))
    assert empty.count() == len(ODD) and "predicted" in empty.columns
    assert len({r["score"] for r in empty.collect()}) == 1
    assert module.judged(rows.where("false"), tables[1]).count() == 0


def test_labels_of_the_held_out_fold_are_never_read(spark, tables):
    flipped = tables[1].selectExpr(
        "doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality", "toxic"
    )
    docs = tables[0].where("doc_id < 400").select("doc_id", "text")
    one = by_id(quality_classifier.judged(docs, tables[1]))
    two = by_id(quality_classifier.judged(docs, flipped))
    assert {i: r["score"] for i, r in one.items()} == {i: r["score"] for i, r in two.items()}


def test_positive_unlabelled_risk_learns_the_word():
    s = toxicity.Settings(bits=12, min_texts=2)
    rng = np.random.default_rng(1)
    clean = [np.unique(rng.integers(10, 4000, 20)) for _ in range(300)]
    toxic = [np.append(rng.integers(10, 4000, 20), 5) for _ in range(60)]
    w, b = toxicity.fit_nnpu(toxic[:30], clean + toxic[30:], 0.1, s)
    assert toxicity.sigmoid(b + w[5]) > 0.6 > 0.3 > toxicity.sigmoid(b)


def test_base_rules_equal_plain_counts(spark, tables):
    extra = [(10**6 + i, t) for i, t in enumerate([None, "", "\n\n", "a a a a a a", "x y z x y z x", "l\nl\nl \n", "α#β c d*", "a b c " * 9000])]
    docs = tables[0].where("doc_id < 300").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.base(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == base_rules(texts[r["doc_id"]])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_quality_rules_keep_good_texts(spark, tables):
    labels = {r["doc_id"]: r["quality"] for r in tables[1].collect()}
    rows = [r for r in quality_rules.op9_quality_rules(spark, SF).collect() if r["doc_id"] in labels and not r["base_failed"]]
    kept = {q: np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == q]) for q in (0, 1)}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_quality_rules_of_odd_rows(spark, tables, odd):
    trusted = tables[1].where("quality = 1").select("doc_id")
    got = quality_rules.judged(odd, trusted)
    assert got.count() == len(ODD) and not any(r["kept"] for r in got.collect())
    assert quality_rules.judged(odd.where("false"), trusted).count() == 0
    plain = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert quality_rules.judged(plain, trusted.where("false")).first()["kept"]


def test_log_ratio_equals_counts_by_hand(spark):
    s = quality_rules.Settings(buckets=64)
    docs = spark.createDataFrame([(1, "a b a"), (2, "c!! c!!"), (3, None)], "doc_id long, text string")
    celled = quality_rules.grams(docs, s)
    cells = {r["doc_id"]: r["grams_"] for r in celled.collect()}
    assert [len(cells[i]) for i in (1, 2, 3)] == [5, 7, 0]
    weights = quality_rules.ratios(celled, spark.createDataFrame([(1,)], "doc_id long"), s).first()["weights_"]
    raw, good = np.bincount(cells[1] + cells[2], minlength=64), np.bincount(cells[1], minlength=64)
    want = np.log((good + 1) / (good.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    assert np.allclose(weights, want)


def test_labels_without_document_do_not_count(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 4 == 0 else f"good word {i % 3}") for i in range(40)], "doc_id long, text string")
    rows = [(i, int(i % 4 == 0)) for i in range(40)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    more = spark.createDataFrame(rows + [(i, 1) for i in range(100, 400)], "doc_id long, toxic int")
    s = toxicity.Settings(bits=10, min_texts=2, max_positives=8)
    (w, b), (w_more, b_more) = toxicity.fit(docs, labels, docs, s), toxicity.fit(docs, more, docs, s)
    assert b == b_more and np.array_equal(w, w_more)


def test_all_trusted_texts_are_counted(spark, tmp_path):
    """Where every text is trusted both models are the same, so every score is 0; a sample of the labels would not give that."""
    ids = spark.range(25_000).withColumnRenamed("id", "doc_id")
    ids.withColumn("text", F.concat(F.lit("word "), F.pmod("doc_id", F.lit(977)))).write.parquet(f"{tmp_path}/documents.parquet")
    ids.union(spark.range(30_000, 60_000)).withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_rules.op9_quality_rules(spark, str(tmp_path)).agg(F.count("score"), F.max(F.abs("score"))).first()
    assert got[0] == 25_000 and got[1] == 0


@pytest.mark.parametrize("values", [[3.5], [0.25, -1.5], [0.5] * 7 + [0.75], [((i * 7919) % 1009) / 997 - 0.4 for i in range(3001)], []])
def test_quartiles_equal_numpy(spark, values):
    scores = spark.createDataFrame([(v,) for v in values], "score double").repartition(5)
    low, high = quality_rules.quartiles(scores).first()
    if not values:
        assert low is None and high is None
    else:
        assert np.allclose([low, high], np.percentile(values, [25, 75]), rtol=0, atol=1e-12)
