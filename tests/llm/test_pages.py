"""URL filter and HTML extraction: rules and texts by hand, plain extraction of the pages, odd inputs."""

from __future__ import annotations

import html
import re

import numpy as np

from sourceloom.llm import html_extraction as H
from sourceloom.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def test_rules(spark):
    rows = [
        "http://A.Example.ORG/es/x", "https://example.org/en/1?x", "https://example.org/en/2", "http://notexample.org/es/",
        "http://org/", "http://x.com/fr/", "http://x.com/de/a#b", "http://x.com/en", "http://x.com?/fr/", "mailto:a@b.org", None, "",
        "http://example.org", "HTTP://a.b.COM/fr/é",
    ]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(rows)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert [got[i]["rule"] for i in range(len(rows))] == [
        "example.org/es/", "example.org/en/1", "org/", "org/", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, "com/fr/",
    ]
    assert [got[i]["verdict"] for i in range(7)] == ["block", "block", "allow", "allow", "allow", "allow", "block"]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.org", "/es/x")
    assert (got[6]["path"], got[8]["host"], got[8]["path"]) == ("/de/a", "x.com", "")
    assert all(got[i]["host"] == got[i]["path"] == "" for i in (9, 10, 11))
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert U.judge(pages.where("false")).count() == 0


def test_ratio_separates_unseen_urls(spark):
    good = [(f"news{i}.example.net/article/{i}", True) for i in range(200)]
    bad = [(f"casino{i}.example.net/bets/{i}", False) for i in range(200)]
    ratio = U.fit(spark.createDataFrame(good + bad + [(None, True), ("", False)], "text string, accepted boolean"))
    unseen = spark.createDataFrame([("news999.example.net/article/x",), ("casino999.example.net/bets/x",), ("n" * 5000,)], "t string")
    a, b, _ = (r["d"] for r in unseen.select(U.difference(unseen, ratio, "t").alias("d")).collect())
    assert a > ratio.threshold > b
    assert not U.fit(spark.createDataFrame(good, "text string, accepted boolean")).ready


def test_counts_equal_plain_counts(spark):
    s = U.Settings(order=2, bits=8)
    urls = spark.createDataFrame([("ab", True), ("ab", True), ("ba", False)], "text string, accepted boolean").repartition(3)
    for model, texts in ((1, ["ab", "ab"]), (0, ["ba"])):
        want = np.zeros((2, (s.order + 1) << s.bits), int)
        for t in texts:
            for kind, at in enumerate(U.cells(t, s)):
                np.add.at(want[kind], at.ravel(), 1)
        got = np.zeros_like(want)
        for r in U.counts(urls, s).where(f"model = {model}").collect():
            got[r["kind"], r["cell"]] = r["n"]
        assert (got == want).all()


def test_blocks():
    page = (
        "<html><head><title>T &amp</title><script>var a='<p>';</script></head><body><!-- <p>no</p> --><nav><a href=/>x</a></nav>"
        "<div class='post'><p>One<br>two &eacute;&#233; <b>three\n four<p>Five<ul><li>six<li>seven</ul></div><footer>&copy; f</footer><p>cut <a hr"
    )
    got = [(b.text, b.path[-1]) for b in H.blocks(page)]
    assert [t for t, _ in got] == ["T &", "x", "One two éé three four", "Five", "six", "seven", "© f", "cut"]
    assert got[2][1] == "p" and "c:post" in H.blocks(page)[2].path
    assert H.blocks(None) == [] and H.blocks("") == [] and [b.text for b in H.blocks("plain")] == ["plain"]
    assert len(H.blocks("<p>a</p>" * 20000)) == 20000


def test_broken_markup():
    def texts(page):
        return [b.text for b in H.blocks(page)]

    assert texts("<article><p title=it's>Hello</p><p>World it's</p><p>More</p>") == ["Hello", "World it's", "More"]
    assert texts('<p title="5" 6">Hello</p><p a = ">" b=\'>\'>x') == ["Hello", "x"]
    assert texts("A&<b>lt;</b>x &lt;p&gt; &amp;lt;") == ["A&lt;x <p> &lt;"]
    assert texts("<p a=\"x>one</p><p>two") == ["one", "two"]
    assert texts("<p =>one<p = = >two<p a=>three</ p></>four") == ["one", "two", "threefour"]
    assert texts("<script data-a='>'>no</script ><style-guide>yes</style-guide>") == ["yes"]
    quoted = H.blocks("<div CLASS = 'post  a-b' data-class=ad id=main>x")[0]
    assert quoted.path == ("div", "c:post", "c:a", "c:b", "i:main")


def test_many_open_tags_are_linear():
    page = H.blocks("<div class=a><section>" + "<div><p>x" * 60_000 + "</section>y</div>z")
    assert len(page) == 60_002 and page[-1].path == () and page[-2].path == ("div", "c:a")
    assert len(H.vectors(page, H.Settings())) == 60_002


def test_article_in_unseen_class_names(spark):
    """No word of the path says article; nearly all of its blocks are found, and no other block is taken."""
    model, s = H.fit(spark.read.parquet(f"{SF}/pages.parquet")), H.Settings()
    words = "The river rose by a metre in the night. People carried what they could to the upper floor."
    found = []
    for n in (1, 3, 6, 15):
        inner = "<h1>High water</h1>" + "".join(f"<p>{words} Part {i}.</p>" for i in range(n))
        for opening, closing in (("<div class='zz9-plural'>", "</div>"), ("<div id=qwert><div class=yx>", "</div></div>"), ("<div>", "</div>")):
            page = f"<html><body><nav><a href=/>Home</a></nav>{opening}{inner}{closing}<footer>Imprint</footer></body></html>"
            y = H.labelled([H.blocks(page)], model, s)[0]
            assert not y[0] and not y[-1]
            found += y[1:-1].tolist()
    assert np.mean(found) > 0.9


def test_pages_equal_plain_extraction(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in H.op7_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_other_markup_and_odd_pages(spark):
    train = spark.read.parquet(f"{SF}/pages.parquet")
    model = H.fit(train)
    page = (
        "<html><body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><main><h1>Title</h1><p>First part.</p>"
        "<div class='ad'>Buy now</div><p>Second part.</p></main><aside class='sidebar'><p>Other things</p></aside>"
        "<section class='comments'><p>I disagree.</p></section><form><label>Mail</label></form><footer>Imprint</footer></body></html>"
    )
    rows = [(1, page, "t"), (2, None, None), (3, "", ""), (4, "<p", "x"), (1, page, "t"), (5, "<article><p>" + "long word " * 40000 + "</p></article>", "")]
    odd = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in H.extract(odd, model).collect()]
    assert got.count((1, "Title\nFirst part.\nSecond part.")) == 2
    assert {i: t for i, t in got if i in (2, 3, 4)} == {2: "", 3: "", 4: ""}
    assert len(dict(got)[5]) == 40000 * 10 - 1
    assert H.extract(odd.where("false"), H.fit(odd.where("false"))).count() == 0


def test_gradients_of_the_recurrent_net():
    s = H.Settings(path=2, words=2, hidden=3)
    model = H.BiLstm(s)
    rng = np.random.default_rng(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.normal(size=(2, 4, s.width))
    mask, y = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float), rng.integers(0, 2, (2, 4)).astype(float)

    def loss() -> float:
        z = model.logits(x, mask)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for name, at in (("wf", (0, 1)), ("wb", (s.width + 1, 4)), ("cf", (2,)), ("o", (4,)), ("k", (0,))):
        value = model.p[name][at]
        model.p[name][at] = value + 1e-3
        up = loss()
        model.p[name][at] = value - 1e-3
        down = loss()
        model.p[name][at] = value
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3
