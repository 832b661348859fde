"""HTML extraction: a recurrent block labeller (bidirectional LSTM in numpy).

A page is read as the sequence of its leaf blocks: runs of text between block tags, each with the path of open
tags (names, and words of their class, id and role). A block's vector joins hashed path words, hashed
text words (signed, of unit length) and a few measures. A forward and a backward LSTM read the whole page, so
every block is labelled in the context of all others; blocks labelled as content are joined by line
ends.

There are no labels in the tables, so the labeller is taught by example: pages of a bounded sample give
blocks, and the words of their paths say which blocks are article and which are not (``CONTENT``,
``BOILERPLATE``). Copies of these pages are dressed anew: other containers for the article, some of them
without a class or with made-up class names, and menus, notices, adverts, forms, sidebars and comments made from
other pages' text in many guises. There the making of the page gives the labels, so that it learns paths and positions,
not one template.

A place in the tree holds the features of its whole path, made from those of the place around it, so pages with
thousands of open tags cost no more a tag than others. Attributes are read by the states of the HTML standard: quotes
matter at the start of a value only. Character references are decoded within a run of text, never across markup.

Cases: null and empty pages give empty text; a page is read whole, of any length; broken markup is read as far as
it goes (an unfinished tag at the end is markup, an unfinished script or comment hides the rest, a quote that never
closes is part of its attribute, which ends at the next blank or ``>``);
repeated rows give the same text; an empty table gives an empty result; without pages to learn from
the dressed-up built-in page alone teaches; columns named like the outputs are replaced.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import bounded_ids, sampled_texts, ship, sigmoid, table, without, word_hashes

#: Tags that end a block of text; all others are part of a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select"
    " summary table tbody td tfoot th thead title tr ul video".split()
)
#: Their content is never text of the page.
HIDDEN = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object")
VOID = frozenset(["hr"])
#: Attributes of a tag up to its end: a name may hold quotes, and a value is quoted only if it starts so.
ATTRIBUTES = r"""(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?)*+"""
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(HIDDEN) + r")(?=[\s/>])" + ATTRIBUTES + r"(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(" + ATTRIBUTES + r")>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|</(?:[^a-zA-Z>][^>]*)?(?:>|\Z)|<\Z",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(
    r"""(?:[\s/]++|(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|\Z))?)"""
)
NAMED = frozenset(["class", "id", "role"])
PART = re.compile(r"[a-z]+")

CONTENT = frozenset("article main content post entry story".split())
BOILERPLATE = frozenset(
    "head nav header footer aside form menu sidebar side notice cookie consent banner ad ads advert advertisement promo"
    " sponsor comment comments reply replies disqus social share related recommended newsletter subscribe breadcrumb"
    " breadcrumbs pagination login search widget popup modal copyright legal toolbar".split()
)


@dataclass(frozen=True)
class Settings:
    max_rows: int = 240  # pages that are fitted, the first by hash of the id
    max_chars: int = 100_000
    path: int = 96  # sizes of the hashed vectors
    words: int = 16
    hidden: int = 12
    epochs: int = 10
    rate: float = 0.02
    dressed: int = 8  # copies of each page in new dress, each with a random part of its article
    chunk: int = 48  # blocks of a training sequence
    batch: int = 32

    @property
    def width(self) -> int:
        return 2 * self.path + self.words + 6


class Place:
    """An open tag inside others, with the features of its path as bits."""

    __slots__ = ("name", "words", "around", "own", "all", "content", "boilerplate")

    def __init__(self, name: str, words: list[str], around: Place | None, size: int):
        self.name, self.words, self.around = name, words, around
        self.own = 0
        for w in words:
            self.own |= 1 << (zlib.crc32(w.encode()) % size)
        bare = [w.rpartition(":")[2] for w in words]
        self.all = self.own | (around.all if around else 0)
        self.content = not CONTENT.isdisjoint(bare) or (around is not None and around.content)
        self.boilerplate = not BOILERPLATE.isdisjoint(bare) or (around is not None and around.boilerplate)


@dataclass
class Block:
    text: str
    place: Place | None
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Words of the open tags, outermost first."""
        parts, place = [], self.place
        while place:
            parts.append(place.words)
            place = place.around
        return tuple(w for words in reversed(parts) for w in words)


def blocks(page: str | None, size: int = Settings.path) -> list[Block]:
    """Leaf blocks of a whole page in order; blocks without text are left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[Place] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = in_link = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split()) if held else ""
        if text:
            out.append(Block(text, stack[-1] if stack else None, linked))
        held.clear()
        linked = 0

    def leave() -> str:
        name = stack.pop().name
        opened[name] -= 1
        return name

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            held.append(html.unescape(page[at : m.start()]))
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                held.append(" ")
            continue
        if name == "a":
            in_link = 0 if m[2] else 1
        if name == "br":
            held.append(" ")
        if name not in BLOCK:
            continue
        close()
        if m[2]:
            while opened[name] and leave() != name:
                pass
            continue
        top = stack[-1].name if stack else ""
        if top == "p" or (top == name and name in ("li", "dt", "dd", "option", "td", "th", "tr")):
            leave()  # ends without a tag
        if name not in VOID:
            words = [name]
            for a in ATTRIBUTE.finditer(m[4]):
                key = (a[1] or "").lower()
                if key in NAMED and a[2]:
                    words += [f"{key[0]}:{w}" for w in PART.findall(a[2].lower())]
            stack.append(Place(name, words, stack[-1] if stack else None, size))
            opened[name] += 1
    if at < len(page):
        held.append(html.unescape(page[at:]))
    close()
    return out


def taught(block: Block) -> int:
    """1 if the words of the path say article, 0 otherwise."""
    return int(block.place is not None and block.place.content and not block.place.boilerplate)


#: Set bits of path features, as met by this worker; emptied when it holds 20,000.
BITS: dict[int, list[int]] = {}


def set_bits(mask: int) -> list[int]:
    at = BITS.get(mask)
    if at is None:
        if len(BITS) > 20_000:
            BITS.clear()
        at = BITS[mask] = [i for i, c in enumerate(reversed(bin(mask)[2:])) if c == "1"]
    return at


def vectors(page: list[Block], s: Settings) -> np.ndarray:
    """One row per block: all path words, the innermost ones, text words, measures."""
    n = len(page)
    x = np.zeros((n, s.width), np.float32)
    for i, b in enumerate(page):
        if b.place:
            x[i, set_bits(b.place.all)] = 1.0
            x[i, [s.path + k for k in set_bits(b.place.own)]] = 1.0
    base = 2 * s.path
    words = [b.text.lower().split() for b in page]
    sizes = np.array([len(w) for w in words], np.int64)
    h = word_hashes([w for ws in words for w in ws])
    cell = np.repeat(np.arange(n), sizes) * s.words + (h % np.uint64(s.words)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
    bag = np.bincount(cell, weights=sign, minlength=n * s.words).reshape(n, s.words)
    x[:, base : base + s.words] = 0.2 * bag / np.maximum(1.0, np.sqrt((bag * bag).sum(axis=1, keepdims=True)))
    chars = np.array([len(b.text) for b in page], np.float32)
    x[:, base + s.words :] = np.stack(
        [
            np.log1p(chars) / 5,
            np.log1p(sizes) / 5,
            np.minimum(1.0, np.array([b.linked for b in page]) / np.maximum(chars, 1)),
            np.array([b.text[-1] in ".!?" for b in page]),
            np.arange(n) / max(1, n),
            np.ones(n),
        ],
        axis=1,
    )
    return x


class BiLstm:
    """Forward and backward LSTM with a logistic layer on both states; padded batches with a mask."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(11)
        h, d = s.hidden, s.width
        self.h = h
        self.p = {}
        for side in ("f", "b"):
            self.p["w" + side] = rng.normal(0, 1 / np.sqrt(d + h), (d + h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1.0  # remember at first
            self.p["c" + side] = bias
        self.p["o"] = rng.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["k"] = np.zeros(1, np.float32)

    def read(self, x: np.ndarray, mask: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States (batch, time, hidden) of one direction; padding leaves the state as it is."""
        n, t, _ = x.shape
        h = self.h
        w, bias = self.p["w" + side], self.p["c" + side]
        given = x @ w[: x.shape[2]] + bias
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.zeros((n, t, h), np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = given[:, k] + state @ w[x.shape[2] :]
            i, f, o = (sigmoid(z[:, a * h : (a + 1) * h]).astype(np.float32) for a in range(3))
            g = np.tanh(z[:, 3 * h :])
            m = mask[:, k : k + 1]
            new = f * cell + i * g
            th = np.tanh(new)
            if trace is not None:
                trace.append((k, i, f, o, g, cell, th, state, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * th) + (1 - m) * state
            out[:, k] = state
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([self.read(x, mask, "f"), self.read(x, mask, "b")], axis=2) @ self.p["o"] + self.p["k"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        d, h = x.shape[2], self.h
        traces: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.read(x, mask, a, traces[a]) for a in "fb"], axis=2)
        error = (sigmoid(states @ self.p["o"] + self.p["k"]) - y) * mask / mask.sum()
        grads = {"o": np.einsum("nt,nth->h", error, states), "k": np.array([error.sum()])}
        for a, side in enumerate("fb"):
            w = self.p["w" + side]
            top = error[:, :, None] * self.p["o"][a * h : (a + 1) * h]
            gz = np.zeros((*x.shape[:2], 4 * h), np.float32)
            gs, gc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            recurrent = np.zeros((h, 4 * h), np.float32)
            for k, i, f, o, g, cell, th, state, m in reversed(traces[side]):
                gs = gs + top[:, k]
                into = gs * m
                go = into * th
                gn = into * o * (1 - th * th) + gc * m
                z = np.concatenate([gn * g * i * (1 - i), gn * cell * f * (1 - f), go * o * (1 - o), gn * i * (1 - g * g)], axis=1)
                gz[:, k] = z
                recurrent += state.T @ z
                gc = gn * f + gc * (1 - m)
                gs = z @ w[d:].T + gs * (1 - m)
            flat = gz.reshape(-1, 4 * h)
            grads["w" + side] = np.concatenate([x.reshape(-1, d).T @ flat, recurrent])
            grads["c" + side] = flat.sum(axis=0)
        return grads


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in parts)
    x, mask = np.zeros((len(parts), t, parts[0].shape[1]), np.float32), np.zeros((len(parts), t), np.float32)
    for i, p in enumerate(parts):
        x[i, : len(p)], mask[i, : len(p)] = p, 1.0
    return x, mask


def fit_lstm(pages: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> BiLstm:
    """Adam over chunks of labelled pages (vectors, labels)."""
    model = BiLstm(s)
    parts = [(x[a : a + s.chunk], y[a : a + s.chunk]) for x, y in pages for a in range(0, len(x), s.chunk)]
    rng = np.random.default_rng(5)
    m = {k: np.zeros_like(v, np.float32) for k, v in model.p.items()}
    v = {k: np.zeros_like(x, np.float32) for k, x in model.p.items()}
    step = 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(parts))
        for a in range(0, len(order), s.batch):
            chosen = [parts[i] for i in order[a : a + s.batch]]
            x, mask = padded([c[0] for c in chosen])
            y, _ = padded([c[1][:, None] for c in chosen])
            step += 1
            rate = s.rate * (1 - epoch / s.epochs)
            for k, g in model.gradients(x, mask, y[:, :, 0]).items():
                g = np.clip(g, -1.0, 1.0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


#: Dresses: markup around the article, and around what is not part of it.
ARTICLE_DRESS = (
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<main><article class='post'>", "</article></main>"),
    ("<div class='content'>", "</div>"),
    ("<div id='main-content'><div class='entry'>", "</div></div>"),
    ("<div class='page'><section class='story'>", "</section></div>"),
    ("<div id='article-body'>", "</div>"),
    ("<section class='post-content'>", "</section>"),
    ("<div>", "</div>"),
    ("<div class='{0}'>", "</div>"),
    ("<div class='{0}'><div id='{1}'>", "</div></div>"),
    ("<section class='{0} {1}'><div>", "</div></section>"),
)
BEFORE_DRESS = (
    "<nav><ul><li><a href='/'>{0}</a></li><li><a href='/'>{1}</a></li></ul></nav>",
    "<header><h1><a href='/'>{0}</a></h1><p>{1}</p></header>",
    "<div class='header'><div class='logo'>{0}</div></div>",
    "<div id='menu'><a href='/'>{0}</a> <a href='/'>{1}</a></div>",
    "<ul class='breadcrumb'><li>{0}</li><li>{1}</li></ul>",
    "<div class='cookie-notice'><p>{0}</p><button>{1}</button></div>",
    "<div class='notice'>{0}</div>",
    "<div class='banner'>{0}</div>",
    "<div class='ad'>{0}</div>",
    "<aside><p>{0}</p></aside>",
)
INSIDE_DRESS = (
    "<div class='ad'>{0}</div>",
    "<div class='advert'><p>{0}</p></div>",
    "<aside><h3>{0}</h3><p>{1}</p></aside>",
    "<div class='share'><a href='/'>{0}</a></div>",
    "<form><p>{0}</p><label>{1}</label></form>",
    "<div class='related'><ul><li><a href='/'>{0}</a></li></ul></div>",
    "<section class='comments'><h2>{0}</h2><p>{1}</p></section>",
)
AFTER_DRESS = (
    "<footer>{0}</footer>",
    "<div class='footer'><p>{0}</p><p>{1}</p></div>",
    "<div id='comments'><h3>{0}</h3><div class='comment'><p>{1}</p></div><div class='comment'><p>{0}</p></div></div>",
    "<section class='comments'><article class='comment'><p>{0}</p></article></section>",
    "<ol class='comment-list'><li><p>{0}</p></li><li><p>{1}</p></li></ol>",
    "<aside class='sidebar'><h3>{0}</h3><p>{1}</p></aside>",
    "<div class='sidebar'><p>{0}</p></div>",
    "<div id='sidebar'><ul><li><a href='/'>{0}</a></li></ul></div>",
    "<form action='/'><label>{0}</label><input><p>{1}</p></form>",
    "<div class='newsletter'><p>{0}</p></div>",
    "<div class='ad'>{0}</div>",
)
EXAMPLE = "<html><body><nav><a>Home</a></nav><article><h1>A title.</h1><p>Some words here.</p></article><footer>Imprint</footer></body></html>"
LINES = ("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<h2>{}</h2>", "<table><tr><td>{}</td></tr></table>")


def dressed(content: list[str], others: list[str], rng: np.random.Generator, size: int) -> list[tuple[Block, int]]:
    """Blocks of the same article in other markup, with labels known from the making."""

    def pick(dresses: tuple, most: int) -> str:
        chosen = [dresses[i] for i in rng.integers(0, len(dresses), rng.integers(0, most + 1))]
        return "".join(d.format(*[html.escape(others[i]) for i in rng.integers(0, len(others), 2)]) for d in chosen)

    opening, closing = ARTICLE_DRESS[rng.integers(0, len(ARTICLE_DRESS))]
    opening = opening.format(*["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(2)])
    body = [f"<h1>{html.escape(content[0])}</h1>"]
    for text in content[1:]:
        if rng.random() < 0.04:
            body.append(pick(INSIDE_DRESS, 1))
        body.append(LINES[rng.integers(0, len(LINES))].format(html.escape(text)))
    page = f"<html><head><title>{html.escape(content[0])}</title></head><body>{pick(BEFORE_DRESS, 4)}{opening}{''.join(body)}{closing}{pick(AFTER_DRESS, 4)}</body></html>"
    # all that lies around or inside the article is dressed in words of ``BOILERPLATE``
    return [(b, int(b.place is not None and not b.place.boilerplate)) for b in blocks(page, size)]


def examples(pages: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled sequences of the sampled pages, as they are and in new dress."""
    rng = np.random.default_rng(17)
    read = [blocks(p, s.path) for p in [*pages, EXAMPLE]]
    read = [r for r in read if r]
    everything = [b.text[:400] for r in read for b in r[:40]]  # for dressing only
    out = []
    for page in read:
        out.append((vectors(page, s), np.array([taught(b) for b in page], np.float32)))
        content = [b.text for b in page if taught(b)]
        for _ in range(s.dressed if content else 0):
            made = dressed(content[: rng.integers(1, min(len(content), s.chunk) + 1)], everything, rng, s.path)
            out.append((vectors([b for b, _ in made], s), np.array([y for _, y in made], np.float32)))
    return out


def fit(pages: DataFrame, s: Settings = Settings(), page_id: str = "page_id", markup: str = "html") -> BiLstm:
    """Fit on the bounded sample of pages."""
    ids = pages.where(F.col(page_id).isNotNull() & F.col(markup).isNotNull()).select(page_id).distinct()
    sample = sampled_texts(pages, bounded_ids(ids, page_id, s.max_rows), page_id, markup, s.max_chars)
    rows = sample.orderBy("sample_id").select("sample_text").collect()  # at most max_rows pages
    return fit_lstm(examples([r[0] for r in rows], s), s)


def labelled(pages: list[list[Block]], model: BiLstm, s: Settings) -> list[np.ndarray]:
    """Labels of all blocks of each page; pages of similar length are read together, each as one sequence."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        n = max(1, min(64, 4096 // longest))
        some, order = order[-n:], order[:-n]
        x, mask = padded([vectors(pages[i], s) for i in some])
        z = model.logits(x, mask)
        for row, i in enumerate(some):
            out[i] = z[row, : len(pages[i])] > 0
    return out


def extract(pages: DataFrame, model: BiLstm, s: Settings = Settings(), markup: str = "html") -> DataFrame:
    """``pages`` with ``text`` (blocks labelled as content, joined by line ends) and ``n_chars``."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    @F.pandas_udf("string")
    def extracted(column: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(column), 256):
            read = [blocks(p, s.path) for p in column.iloc[a : a + 256]]
            labels = labelled(read, shared.value, s)
            out += ["\n".join(b.text for b, keep in zip(r, y, strict=True) if keep) for r, y in zip(read, labels, strict=True)]
        return pd.Series(out, dtype=object)

    made = without(pages, ["text", "n_chars"]).withColumn("text", extracted(markup))
    return made.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
