"""Spelling variants, periodic runs and suffix deduplication against plain versions; odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sourceloom.llm import periodic_runs, spelling_variants, suffix_dedup
from sourceloom.llm.suffix_sort import Scratch, suffix_order
from tests.llm.plain import WORD

ODD = "doc_id long, text string, spans int, n_words int, kept string, n int, start string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3, "s") for i, t in rows], ODD)


# periodic runs


def plain_runs(words, shortest=6, repeats=4):
    found = []
    for q in range(1, len(words) // repeats + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, hit in enumerate(same):
            if hit and start is None:
                start = i
            if not hit and start is not None:
                a, b = start, i + q
                start = None
                part = words[a:b]
                least = not any(all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q))
                if least and b - a >= max(shortest, repeats * q):
                    found.append((a, b - a, q))
    return sorted(found)


def plain_summary(text, doc_id=None, planted=False):
    words = WORD.findall(text or "")
    if planted and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(found), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def repetitive(rng):
    words = []
    while rng.random() < 0.8 and len(words) < 250:
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
        words += unit * rng.randrange(1, 8)
        words = words[: len(words) - rng.randrange(3)]
    return " ".join(words)


def test_runs_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 8))]
        assert periodic_runs.summaries(texts, None) == [plain_summary(t) for t in texts]


def test_run_columns_of_odd_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(i, repetitive(random.Random(i))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t"), (63, "a"), (64, long), (64, long), (65, "x " * 5000), (66, "é É é É é É é É"), (66, "other")]
    got = periodic_runs.described(odd_docs(spark, rows), planted=True)
    assert got.columns == ["doc_id", "text", "spans", "n_words", "kept", "n", *periodic_runs.NAMES]
    found = sorted((tuple(r) for r in got.select("doc_id", "text", *periodic_runs.NAMES).collect()), key=str)
    short = [(i, t, *plain_summary(t, i, True)) for i, t in rows if len(t or "") < 20_000]
    # the plain version would take too long on the long ones, whose runs test_one_long_run checks
    assert found == sorted([*short, *[(i, t, *periodic_runs.summaries([t], [i])[0]) for i, t in rows if len(t or "") >= 20_000]], key=str)
    assert periodic_runs.described(odd_docs(spark, rows).where("false")).count() == 0
    null_id = periodic_runs.described(odd_docs(spark, [(None, "a a a a a a")])).first()
    assert (null_id.n_runs, null_id.start, null_id.length, null_id.period, null_id.exponent_milli) == plain_summary("a a a a a a", "", True)[:5]


def test_one_long_run():
    words = [f"w{i % 700}" for i in range(30_000)]
    row = periodic_runs.summaries([" ".join(words)], None)[0]
    assert row[:5] == (1, 0, 30_000, 700, 1000 * 30_000 // 700)
    assert row[6] == hashlib.sha256(" ".join(words[:700]).encode()).hexdigest()


# spelling variants


def plain_counts(rows, s=spelling_variants.Settings()):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if s.typo_mod and h % s.typo_mod == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: c for w, c in counts.items() if len(w) >= s.min_chars and c >= s.min_count}


def plain_variants(rows, s=spelling_variants.Settings()):
    n = plain_counts(rows, s)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    of = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(of[w]), n[form[w]] if form[w] else -1) for w in n)


def variant_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéñ×") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = base[min(rng.randrange(40), rng.randrange(40))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + "b" + w[k + 1 :]])
            words.append(w if rng.random() < 0.8 else w.title())
        rows.append((i, " ,".join(words)))
    return rows


@pytest.mark.parametrize("settings", [{}, {"tile": 3, "classes": 2, "strip": 10}, {"tile": 7, "typo_mod": 0, "held": 10}])
def test_variants_equal_plain_ones(spark, settings):
    long = "q" * 5000
    rows = [*variant_rows(4), (None, "aaaaa aaaab aaaab ÉTÉÉTÉ étéété"), (7, None), (8, ""), (9, f"{long} {long}a {long} {long}a {long}a {long}")]
    rows += [(900, "ttttt ttttt ttttt uuuuu uuuuu uuuuu tttttt " * 2)] * 3
    s = spelling_variants.Settings(**settings)
    got = spelling_variants.grouped(spelling_variants.vocabulary(odd_docs(spark, rows).repartition(4), s), s)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.collect())
    assert found == plain_variants(rows, s)
    assert any(f[1] for f in found) and any(f[1] and f[1] != f[2] for f in found)


def test_variants_of_nothing(spark):
    docs = odd_docs(spark, [(1, "one two")])
    assert spelling_variants.grouped(spelling_variants.vocabulary(docs)).count() == 0
    assert spelling_variants.grouped(spelling_variants.vocabulary(docs.where("false"))).count() == 0


# suffixes


@pytest.mark.parametrize("memory, base", [(1 << 28, 10**6), (1 << 12, 2), (16, 0)])
def test_suffix_order_and_prefixes(tmp_path, memory, base):
    rng = random.Random(memory)
    for _ in range(120):
        letters = rng.choice([1, 2, 5, 60])
        parts = []
        for _ in range(rng.randrange(1, 8)):
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
            if parts and rng.random() < 0.5:
                part = rng.choice(parts)[rng.randrange(3) :] + part[:3]
            parts.append((part[:4] * 10)[:30] if rng.random() < 0.2 else part)
        t = np.array([x for p in parts for x in [*(b + 1 for b in p), 0]], np.uint16)
        apart = [x + 1000 if x else int((t[:i] == 0).sum()) for i, x in enumerate(t.tolist())]
        order = sorted((i for i in range(len(t)) if t[i]), key=lambda i: apart[i:], reverse=True)
        with Scratch(str(tmp_path), memory) as scratch:
            found = list(suffix_order(t, 10, scratch, base))
        places = [x for p, _ in found for x in p.tolist()]
        prefixes = [x for _, c in found for x in c.tolist()]
        assert places == order
        for k in range(1, len(order)):
            shared = 0
            while shared < 10 and apart[order[k - 1] + shared] == apart[order[k] + shared]:
                shared += 1
            assert prefixes[k] == shared
    assert not any(tmp_path.iterdir())  # scratch files go with the shard


def plain_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (i, t), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, t, len(b), spans, kept))
    return sorted(out, key=str)


def shared_passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passages = [text(rng.choice([30, 45, 60, 200])) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(60)) if rng.random() < 0.5 else rng.choice(passages)[rng.randrange(20) :] for _ in range(4)]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(20)]  # copies
    hot = text(30)  # in many contexts: its gram is split
    rows += [(300 + i, text(50) + hot + text(50)) for i in range(80)]
    rows += [(400, "z" * 300), (401, "xy" * 200), (402, None), (403, ""), (404, "short"), (405, text(40)), (None, text(90)), (None, passages[0] * 2)]
    return rows + [(500, rows[0][1])] * 2


@pytest.mark.parametrize(
    "settings",
    [{}, {"hot": 4000, "shard": 5000, "salt": 50}, {"block": 64, "held": 3000, "memory": 1 << 12, "base": 20, "bits": 16}],
)
def test_repeats_equal_plain_ones(spark, settings):
    rows = shared_passages(6)
    s = suffix_dedup.Settings(length=40, gram=20, **settings)
    got = suffix_dedup.without_repeats(odd_docs(spark, rows).repartition(5), s)
    assert got.columns == ["doc_id", "text", "spans", "n_words", "n", "start", "n_bytes", "removed", "kept"]
    found = [(r.doc_id, r.text, r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=str) == plain_repeats(rows, 40)


def test_repeats_of_nothing(spark):
    docs = odd_docs(spark, [(1, "one"), (2, None)])
    assert [r.n_bytes for r in suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()] == [3, 0]
    assert suffix_dedup.without_repeats(docs.where("false")).count() == 0


def test_registered_queries_read_whole_tables(spark):
    from sourceloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op13_suffix_dedup"](spark, folder).collect()}
    for i, _, size, spans, kept in plain_repeats([tuple(r) for r in docs], 200):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert {r.word: r.n for r in QUERIES["op11_spelling_variants"](spark, folder).collect()} == plain_counts([tuple(r) for r in docs])
    assert {r.doc_id for r in QUERIES["op12_periodic_runs"](spark, folder).collect()} == {r.doc_id for r in docs}


def test_workers_get_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, found = spark.conf.get(key), suffix_dedup.frequent_grams
    monkeypatch.setattr(suffix_dedup, "frequent_grams", lambda docs, s: seen.append(spark.conf.get(key)) or found(docs, s))
    assert suffix_dedup.without_repeats(odd_docs(spark, [(1, "one"), (2, "two")])).count() == 2
    assert seen == [str(suffix_dedup.Settings.batch)] and spark.conf.get(key) == before


def gram_of_segments(rng: random.Random, n: int) -> list[bytes]:
    """Distinct segments of one gram: up to 20 bytes before and behind its 20, as windows of 40 allow."""
    out = set()
    while len(out) < n:
        left, right = ("".join(rng.choice("ab") if rng.random() < 0.15 else "a" for _ in range(rng.randrange(8, 21))) for _ in range(2))
        if len(left + right) >= 20:
            out.add((left + "0123456789ABCDEFGHIJ" + right).encode())
    return sorted(out)


@pytest.mark.parametrize("n, often", [(2, 1), (2, 2), (3, 1), (12, 1), (40, 3)])
def test_segments_of_a_gram_equal_brute_force(n, often):
    s = suffix_dedup.Settings(length=40, gram=20)
    for seed in range(20):
        rng = random.Random(seed)
        rows, places = [], {}
        for gram in (5, 9):
            for i, content in enumerate(gram_of_segments(rng, n)):
                content = content.replace(b"0", b"%d" % gram)  # another gram
                count = often if i == 0 else 1
                rows.append((gram, gram, i, count, content, content.index(b"%d123" % gram)))
                for w in range(len(content) - s.length + 1):
                    places.setdefault(content[w : w + s.length], []).extend([(gram, i, w)] * count)
        want = {place for same in places.values() if len(same) > 1 for place in same}
        found = [span for part in suffix_dedup.shard_spans(iter(rows), s) for span in part]
        assert {(d1, d2, w) for d1, d2, a, b in found for w in range(a, b)} == want


def test_only_stretches_that_differ_are_sorted(monkeypatch):
    s = suffix_dedup.Settings(length=40, gram=20)
    sizes, order = [], suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda t, *rest: sizes.append(len(t)) or order(t, *rest))
    gram = b"0123456789ABCDEFGHIJ"
    left, right = b"abcdefghijklmnopqrst", b"ABCDEFGHIJKLMNOPQRST"
    pair = [(1, 1, 0, 1, b"x" * 5 + left[5:] + gram + right, 20), (1, 1, 1, 1, left + gram + right[:12], 20)]
    assert [x for part in suffix_dedup.shard_spans(iter(pair), s) for x in part] == [(1, 0, 5, 13), (1, 1, 5, 13)]
    apart = [(2, 2, i, 1, bytes([97 + i]) * 20 + gram + bytes([97 + i]) * 20, 20) for i in range(9)]
    assert not [x for part in suffix_dedup.shard_spans(iter(apart), s) for x in part]
    assert not sizes
