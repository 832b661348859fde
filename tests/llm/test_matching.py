"""N-gram join, decontamination, license scan and packing against plain versions; odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from sourceloom.llm import decontamination, license_scan, ngram_join, packing
from tests.llm.plain import link_groups, shingle_set

DOCS = "doc_id long, text string, n_shingles int, matches string"


def varied(seed: int, copies: int) -> dict[int, str]:
    """Near copies with 0 to 4 changed words, exact copies, a shared passage, and unrelated texts."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    shared = [f"s{i}" for i in range(40)]
    out = {}
    for i in range(copies):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        out[len(out)] = " ".join(words)
    for i in range(copies // 2):
        own = [f"o{i}_{k}" for k in range(rng.randrange(3, 60))]
        out[len(out)] = " ".join(shared + own if i % 2 else own + shared)
    for i in range(10):
        out[len(out)] = out[i].upper()
    for text in ("", " ", "one", "one two", "one two", "A B c d", "a b C d"):
        out[len(out)] = text
    return out


@pytest.mark.parametrize("rare, settings", [(64, {}), (4, {}), (4, {"words": 5, "num": 80}), (2, {"rounds": 0})])
def test_groups_equal_all_pairs(spark, rare, settings):
    texts = varied(rare, 60)
    s = ngram_join.Settings(rare=rare, **settings)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = ngram_join.grouped(docs, s).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == link_groups(texts, s.words, s.num, s.den)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(shingle_set(t, s.words)) for i, t in texts.items()}


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(7, None), (8, ""), (9, long), (9, long), (3, long + " end"), (None, "a b c d e"), (None, None), (5, "a b c d e")]
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.grouped(docs).collect()), key=str)
    assert got == sorted([(7, 7), (8, 8), (9, 3), (9, 3), (3, 3), (None, 5), (None, None), (5, 5)], key=str)
    assert ngram_join.grouped(docs.where("false")).count() == 0
    kept = ngram_join.representatives(docs, ngram_join.Settings())
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id").collect(), key=str) == [(3,), (5,), (7,), (8,), (None,), (None,)]


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta."), (2, "tiny item"), (3, None), (4, "..."), (5, " ".join(f"q{i}" for i in range(40)))]


def test_passages_are_found_with_their_place(spark):
    near = [f"q{i}" for i in range(40)]
    near[0], near[39] = "other", "end"
    texts = [
        (10, "some words before, alpha BETA gamma; delta epsilon (zeta) eta theta! and after"),
        (11, "a Tiny item here"),
        (12, "before " + " ".join(near) + " after"),
        (13, " ".join(f"q{i}" for i in range(20))),
        (14, "alpha beta gamma delta epsilon"),
        (15, None),
        (16, ""),
        (17, "z " * 40000 + "tiny item"),
        (17, "z " * 40000 + "tiny item"),
    ]
    docs = spark.createDataFrame([(i, t, 1, "old") for i, t in texts], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = [(r["doc_id"], m["item_id"], r["text"][m["begin"] : m["end"]]) for r in decontamination.matched(docs, items).collect() for m in r["matches"]]
    assert (10, 1, "alpha BETA gamma; delta epsilon (zeta) eta theta") in found
    assert (11, 2, "Tiny item") in found
    assert {(i, j) for i, j, _ in found} == {(10, 1), (11, 2), (12, 5), (17, 2)}
    clean = decontamination.clean(docs, items)
    assert sorted(r["doc_id"] for r in clean.collect()) == [13, 14, 15, 16]
    assert decontamination.clean(docs, items.where("false")).count() == len(texts)
    assert decontamination.clean(docs.where("false"), items).count() == 0
    blocks = decontamination.matched(docs, items, decontamination.Settings(block_items=2))
    assert sum(len(r["matches"]) for r in blocks.collect()) == len(found)


def test_search_equals_all_windows():
    rng = random.Random(2)
    s = decontamination.Settings()
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(3, 30))) for _ in range(20)]
    items = decontamination.Items(list(range(20)), texts, s)
    for _ in range(30):
        words = [rng.choice("klm") for _ in range(20)] + texts[rng.randrange(20)].split() + ["k"] * 5
        if rng.random() < 0.5:
            words[20 + rng.randrange(3)] = "changed"
        h = decontamination.words_of(" ".join(words))
        want = set()
        for item, w in enumerate(items.words):
            for a in range(len(h) - len(w) + 1):
                if decontamination.weighted(decontamination.shingles(h[a : a + len(w)], 5), items.grams[item]) >= s.similarity:
                    want.add(item)
        assert {m[0] for m in items.search(" ".join(words))} == want


def test_hamming_blocks_lose_nothing():
    rng = np.random.default_rng(3)
    items = decontamination.Items([0], ["a b c d e f"], decontamination.Settings())
    (_, prints, _) = items.index[6]
    for flips in range(16):
        bits = rng.choice(64, flips, replace=False).astype(np.uint64)
        other = prints[0] ^ np.bitwise_or.reduce(np.append(np.uint64(1) << bits, np.uint64(0)))
        assert items.near(6, np.array([other], np.uint64)) == {(0, 0)}


def test_licenses(spark):
    filler = " ".join(f"w{i}" for i in range(900))
    texts = [
        (1, f"{filler}\nLicensed under the Apache License, Version 2.0.\n{filler}"),
        (2, "RELEASED UNDER THE MIT LICENSE"),
        (3, filler + " released under the mit terms " + filler),
        (4, None),
        (5, ""),
        (6, "x " * 50000 + license_scan.NOTICES[3][1]),
        (2, "RELEASED UNDER THE MIT LICENSE"),
        (7, "This work is licensed under the GNU General Public License, version 2."),
    ]
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in texts], DOCS)
    got = {(r["doc_id"], r["template"]): r for r in license_scan.scan(docs).collect()}
    assert set(got) == {(1, 0), (2, 4), (6, 3), (7, 2)}
    assert got[1, 0]["first_word"] == 900 and got[1, 0]["last_word"] == 907 and got[1, 0]["containment"] == 1.0
    assert got[7, 2]["containment"] == pytest.approx(0.9)
    assert license_scan.scan(docs.where("false")).count() == 0
    assert license_scan.scan(docs, ()).count() == 0


def test_license_scan_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", None, "Don't <|endoftext|> stop\x1cnow é ́x 12ab", "ΑΣ İ ǅ z", "word, Word! wörd " * 900, "a"]
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in enumerate(texts)], DOCS)
    rows = packing.pieces(docs, ids=True).collect()
    for i, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == want
        assert all(r["length"] == 2048 for r in mine[:-1]) and mine[0]["start"] == 0
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)


def test_packing_fills_sequences(spark):
    rng = random.Random(4)
    lengths = [rng.choice([3, 3, 3, 500, rng.randrange(1, 2049)]) for _ in range(3000)]
    rows = [(i // 2, 0, 0, n, i) for i, n in enumerate(lengths)]  # repeated keys
    made = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    placed = packing.packed(made, packing.Settings(bucket_rows=40, block=16)).collect()
    assert len(placed) == len(rows)
    ends: dict[int, int] = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert len(ends) <= sum(lengths) / 2048 * 1.02 + 1
    assert packing.packed(made.where("false")).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 7)) for i in range(40)], "doc_id long, text string")
    made = packing.pieces(docs, packing.Settings(size=32), ids=True)
    whole = packing.sequences(packing.packed(made, packing.Settings(size=32))).collect()
    assert sum(len(r["ids"]) for r in whole) == made.selectExpr("sum(length) n").first()["n"]
    assert all(len(r["ids"]) <= 32 for r in whole)


def named(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license_scan.scan(docs).collect()
    return [sorted(r["license"] for r in found if r["doc_id"] == i) for i in range(len(texts))]


def test_licenses_are_told_apart(spark):
    work = "This work is licensed under the GNU {}General Public License, version {}."
    head = license_scan.NOTICES[3][1]
    cases = [
        (work.format("", "2"), ["GPL-2.0"]),
        (work.format("", "3"), ["GPL-3.0"]),
        (work.format("Lesser ", "3"), ["LGPL-3.0"]),
        (work.format("Lesser ", "2.1"), ["LGPL-2.1"]),
        (work.format("Affero ", "3"), ["AGPL-3.0"]),
        (head, ["GPL-3.0"]),
        (head.replace("version 3", "version 2"), ["GPL-2.0"]),
        (head.replace("GNU General", "GNU Affero General"), ["AGPL-3.0"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Text under CC BY-SA 3.0, as it is", ["CC-BY-SA-3.0"]),
        ("This is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("Distributed under the ISC License", ["ISC"]),
        ("Code is under the BSD 3-Clause License", ["BSD-3-Clause"]),
        ("released under the Unlicense", ["Unlicense"]),
        ("Licensed under the Apache License, Version 2.0. " + "w " * 30 + "Released under the MIT License.", ["Apache-2.0", "MIT"]),
        ("nothing about licenses of any version 3", []),
    ]
    assert named(spark, [t for t, _ in cases]) == [w for _, w in cases]


def test_full_license_texts(spark):
    full = [t for t in license_scan.TEMPLATES if len(t.text) > 600]
    assert len(full) > 15
    got = named(spark, [f"a b c {t.text} x y z" for t in full])
    assert [t.license in g for t, g in zip(full, got)] == [True] * len(full), got


def test_edited_copies_cross_windows(spark):
    words = license_scan.NOTICES[17][1].split()
    # a word put in after every sixteenth, at several offsets
    longer = " ".join(w + (" inserted" if i % 16 == 15 else "") for i, w in enumerate(words))
    texts = ["f " * k + longer for k in range(0, 2 * len(words), 37)]
    assert all("Zlib" in g for g in named(spark, texts))


@pytest.mark.parametrize("settings", [{"rare": 4, "small": 4}, {"rare": 4, "small": 4, "rounds": 0}, {"rare": 2, "small": 2, "words": 2}])
def test_large_group_that_shares_a_passage_and_does_not_link(spark, settings):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    texts = {}
    for i in range(90):  # edited in different ways, so most do not link with each other
        words = list(passage)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(12)}"
        texts[len(texts)] = " ".join(words)
    for i in range(60):
        texts[len(texts)] = " ".join([*passage, *[f"o{i % 20}_{k}" for k in range(rng.randrange(16))]])
    s = ngram_join.Settings(**settings)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.grouped(docs, s).collect()}
    assert found == link_groups(texts, s.words, s.num, s.den)
    assert len(set(found.values())) > 20


def test_words_are_hashed_as_they_are_split():
    s = ngram_join.Settings(block=64, long_word=20)
    texts = ["", "  \t\n", "A\x0bb\x1cc D\x85e", "x" * 50 + " Y " + "X" * 50 + " " + "x" * 51, "ab " * 100 + "é É ß", " ".join(f"w{i}" for i in range(90))]
    for text in texts:
        words = [w.lower() for w in text.encode().split()]
        found = ngram_join.word_hashes(np.frombuffer(text.encode(), np.uint8), s).tolist()
        assert len(found) == len(words) and len(set(zip(words, found, strict=True))) == len(set(words)) == len(set(found))


def test_one_pass_measures_and_emits(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "A b c d e F"), (4, "x")], "doc_id long, text string").coalesce(1)
    rows = ngram_join.measured(docs, ngram_join.Settings()).collect()
    assert {(r["doc_id"], r["n"]) for r in rows if r["range"] is None} == {(1, 3), (2, 0), (3, 3), (4, 1)}
    assert sum(len(r["tokens"]) for r in rows if r["range"] is not None) == 8 * 4  # copies emit once


def test_differences_that_meet_nothing_are_no_rows(spark):
    sets = {1: [10, 20, 30], 2: [10, 20, 40, 50], 3: [10, 20, 40, 60]}
    made = spark.createDataFrame([(k, np.array(v, np.uint64).tobytes()) for k, v in sets.items()], "node long, tokens binary")
    around = spark.createDataFrame([(1, 3, 2, 4, 2), (1, 3, 3, 4, 3)], "centre long, n_c long, node long, n long, label long")
    rows = ngram_join.differences(around, made, ngram_join.Settings()).collect()
    assert rows and all((r["token"], r["i"]) in ((30, 1), (40, 2)) and r["x"] == 3 for r in rows)


def test_pieces_are_tokenised_once_for_many_words():
    known = packing.WordIds(packing.tokenizer_path(), 100)
    texts = ["Ab ab AB ab, it's Été.\x85x²", "a\x1cb", "漢 ab", "<|endoftext|> ab", "", " "]
    for text in texts:
        assert known.ids(text).tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(known.pieces.at) == ["ab", ",", "it", "'s", "été", ".", "x", "²"]
    known.clear()
    assert not known.pieces.at and not known.words.at


def test_short_texts_take_no_room_of_a_block(monkeypatch):
    one = np.ones(1, np.uint64)
    monkeypatch.setattr(ngram_join.Powers, "up", one)
    monkeypatch.setattr(ngram_join.Powers, "down", one)
    s = ngram_join.Settings()
    found = ngram_join.word_hashes(np.frombuffer(b"some words of a short text", np.uint8), s)
    assert len(found) == 6 and len(ngram_join.Powers.up) < 100 and len(ngram_join.Powers.down) < 100


def test_large_buckets_hold_nodes_that_can_link_and_one_centre_each(spark):
    base = list(range(100))
    sets = {1: base, 2: [*base[1:], 200], 3: [*base[2:], 201, 202], 4: [*base[40:], *range(300, 340)]}  # 4 can link with nothing
    made = spark.createDataFrame([(k, v) for k, v in sets.items()], "node long, tokens array<long>")
    buckets = {10: (1, 2, 3, 4), 11: (2, 3, 4), 12: (3, 2)}  # each has another centre
    rows = [(key, node, 100, at, node) for key, nodes in buckets.items() for at, node in enumerate(nodes)]
    large = spark.createDataFrame(rows, "key long, node long, n long, before int, label long")
    s = ngram_join.Settings()
    kept = ngram_join.able(large, made, s)
    assert {r["node"] for r in kept.collect()} == {1, 2, 3}
    around, named = ngram_join.centred(large.where("node < 4"), kept, s)
    assert {(r["node"], r["centre"]) for r in around.collect()} == {(1, 1), (2, 1), (3, 1), (2, 2), (3, 2), (2, 3), (3, 3)}
    assert sorted((r["node"], r["centre"], r["n_c"], r["label_c"]) for r in named.collect()) == [(k, 1, 100, 1) for k in (1, 2, 3)]


def test_sets_are_compared_without_python_workers(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3, 4]), (3, [1, 7, 8]), (-4, [1, 2])], "node long, tokens array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (-4, 1)], "a long, b long")
    found = ngram_join.linked(pairs, sets, ngram_join.Settings(num=2, den=3))
    assert sorted(tuple(r) for r in found.collect()) == [(-4, 1), (1, 2)]
    assert "Python" not in found._jdf.queryExecution().toString()
    assert ngram_join.components(pairs.where("a = 9")).isEmpty()
