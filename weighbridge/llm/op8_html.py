"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is cut at block-level tags; each block knows its ancestor tags, words of its ancestors' class, id and role, the share of its text
in links, and simple facts of its text. The field labels the blocks in page order as article or rest; it is trained by
gradient ascent on labelled pages and decoded by the Viterbi algorithm. Labelled pages are those of the table whose
markup says where the article is (article, main, role=main, itemprop=articleBody), out of the SAMPLE distinct ones with the
least hash of their html among those of up to LONGEST characters, and pages made from the layouts below. Each is seen twice, once without what the
label was read from, so that pages without such markup are labelled too.

White space is Unicode white space. A null, empty or textless page has an empty text. Every row gives a row; nulls in
page_id and url stay. Rows that repeat give equal rows. Broken markup is read as browsers do in the main: unclosed
comments, scripts and tags run to their end or to the end of the page.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import common

SAMPLE = 300
LONGEST = 200_000
STEPS = 60
#: Tags that end a block; tags without content; tags whose content is not text of the page.
BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript plaintext script style svg template textarea title xmp".split())
#: A start tag of the first kind ends an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role attributes, by what they hint at.
HINTS = {
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs",
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner",
    "side": "sidebar side aside widget related recommended recirc share sharing social complementary popular trending tags",
    "comments": "comment comments reply replies discussion disqus respond reader",
    "foot": "footer foot copyright legal contentinfo bottom",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay banner newsletter subscribe subscription paywall",
    "head": "header head masthead logo top topbar site",
    "form": "form search login signup register",
    "body": "content article post entry story body text main articlebody hentry prose",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
INSIDE = "nav footer header aside form article main section ul ol table figure blockquote dialog menu details".split()
OWN = "p h1 h2 h3 h4 h5 h6 li td th div blockquote pre figcaption dd dt a label button option legend summary article section body".split()
FEATURES = [*(f"in:{t}" for t in INSIDE), *(f"hint:{h}" for h in HINTS), *(f"own:{t}" for t in OWN), "own:other", "words:1", "words:2-4", "words:5-14", "words:15-39", "words:40+", "links:none", "links:some", "links:half", "links:most", "ends:stop", "has:comma", "has:(c)", "has:date", "first", "last", "before h1", "bias"]
AT = {f: i for i, f in enumerate(FEATURES)}
GIVEN = [AT["in:article"], AT["in:main"], AT["hint:body"]]
BITS = {f: 1 << i for f, i in AT.items()}
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: What follows a tag that nothing closes: other starts of tags that the same end leaves unclosed, and what is no such start.
OPEN = re.compile(r"""(<)(?=/?[a-zA-Z][^\s/>"']*+(?:[\s/]|\Z))|[^"'<>]++|<|"[^"]*"|'[^']*'""")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
DATE = re.compile(r"\b(?:19|20)\d\d\b")


class Parsed:
    """The blocks of a page: their texts, features as bits, and whether the markup puts them into an article."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.bits: list[int] = []
        self.inside: list[bool] = []
        self.marked = False


def _hints(attributes: str) -> tuple[int, bool]:
    bits, article = 0, False
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        article |= (name.lower() == "role" and value.lower() == "main") or (name.lower() == "itemprop" and value.lower() == "articlebody")
        for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            if w in HINT_OF:
                bits |= BITS["hint:" + HINT_OF[w]]
    return bits, article


def parse(page: str) -> Parsed:
    out = Parsed()
    stack: list[tuple[str, int, bool]] = [("body", 0, False)]
    held: Counter[str] = Counter()  # tags on the stack
    unclosed: set[int] = set()  # where tags start that are known to be unclosed
    buffer: list[str] = []
    linked, links, seen_h1, pos, size = 0, 0, False, 0, len(page)
    lower = None

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            tag, bits, inside = next((x for x in reversed(stack) if x[0] in BLOCK), stack[0])
            n = len(text.split())
            share = linked / len(text)
            bits |= BITS[f"own:{tag}"] if f"own:{tag}" in BITS else BITS["own:other"]
            bits |= BITS["words:1" if n == 1 else "words:2-4" if n < 5 else "words:5-14" if n < 15 else "words:15-39" if n < 40 else "words:40+"]
            bits |= BITS["links:none" if share == 0 else "links:some" if share < 0.3 else "links:half" if share < 0.7 else "links:most"]
            bits |= BITS["ends:stop"] * (text[-1] in ".!?:;\"'”’»…") | BITS["has:comma"] * ("," in text) | BITS["has:(c)"] * ("©" in text) | BITS["has:date"] * bool(DATE.search(text)) | BITS["before h1"] * (not seen_h1 and tag != "h1") | BITS["bias"]
            out.texts.append(text)
            out.bits.append(bits)
            out.inside.append(inside)
        linked = 0

    def close(names: set[str], stop: frozenset[str] | set[str]) -> None:
        """Pop to the nearest of names unless something of stop is nearer."""
        nonlocal links
        if not any(held[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                links -= sum(x[0] == "a" for x in stack[k:])
                held.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            at = size
        if at > pos:
            text = html.unescape(page[pos:at])
            buffer.append(text)
            if links:
                linked += len(" ".join(text.split()))
        if at >= size:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pos = size if end < 0 else end + 1
            continue
        m = None if at in unclosed else TAG.match(page, at + 1)
        if not m:
            if at + 1 < size and (page[at + 1].isalpha() or page[at + 1] == "/"):
                if at not in unclosed and TAG_NAME.match(page, at + 1):
                    i = TAG_NAME.match(page, at + 1).end()
                    while t := OPEN.match(page, i):
                        if t[1]:
                            unclosed.add(t.start())
                        i = t.end()
                end = page.find(">", at)
                pos = size if end < 0 else end + 1
            else:
                buffer.append("<")
                pos = at + 1
            continue
        pos, closing, tag = m.end(), m[1], m[2].lower()
        if closing:
            if tag in BLOCK:
                flush()
            close({tag}, frozenset())
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == size else page
            if tag in BLOCK:
                flush()
            end = lower.find("</" + tag, pos)
            if end < 0:
                pos = size
            else:
                end = page.find(">", end)
                pos = size if end < 0 else end + 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            close({"p"}, BLOCK - {"p"})
            if tag in ENDS:
                close(ENDS[tag], {"ul", "ol", "table", "dl", "select"})
        if tag in VOID:
            continue
        bits, article = _hints(m[3]) if m[3] else (0, False)
        article |= tag in ("article", "main")
        if "in:" + tag in BITS:
            bits |= BITS["in:" + tag]
        out.marked |= article
        stack.append((tag, stack[-1][1] | bits, (stack[-1][2] or article)))
        held[tag] += 1
        links += tag == "a"
        seen_h1 |= tag == "h1"
    flush()
    if out.bits:
        out.bits[0] |= BITS["first"]
        out.bits[-1] |= BITS["last"]
    return out


#: Hints and tags that take a block out of a marked article, when pages are labelled.
AWAY = sum(BITS[x] for x in ("in:nav", "in:footer", "in:aside", "in:form", "in:dialog", "in:menu", "hint:navigation", "hint:advert", "hint:side", "hint:comments", "hint:notice", "hint:form", "hint:foot"))


def matrix(bits: list[int]) -> np.ndarray:
    return np.array([[b >> i & 1 for i in range(len(FEATURES))] for b in bits], np.float64).reshape(-1, len(FEATURES))


def labelled(page: str) -> tuple[np.ndarray, np.ndarray] | None:
    got = parse(page)
    if not (got.marked and got.texts):
        return None
    return matrix(got.bits), np.array([i and not b & AWAY for b, i in zip(got.bits, got.inside, strict=True)], np.int64)


def layouts(n: int = 60, seed: int = 4) -> list[str]:
    """Labelled pages of common layouts: what surrounds an article differs in place, tag and class."""
    r = random.Random(seed)
    words = "lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()

    def said(a: int, b: int, stop: str = ".") -> str:
        return " ".join(r.choice(words) + ("," if r.random() < 0.1 else "") for _ in range(r.randint(a, b))).capitalize() + stop

    def linked(n: int) -> str:
        return "".join(f'<li><a href="/">{said(1, 3, "")}</a></li>' for _ in range(n))

    around = [
        lambda: f"<nav><ul>{linked(5)}</ul></nav>", lambda: f'<div class="menu"><ul>{linked(6)}</ul></div>', lambda: f'<header><div class="logo">{said(1, 3, "")}</div></header>',
        lambda: f'<div class="ad">{said(3, 12)}</div>', lambda: f'<div class="sponsored"><p>{said(8, 25)}</p></div>', lambda: f'<div id="cookie-notice"><p>{said(8, 30)}</p></div>', lambda: f'<form class="search"><label>{said(1, 2, "")}</label><button>{said(1, 1, "")}</button></form>',
    ]
    after = [
        lambda: f"<aside><h3>{said(1, 3, '')}</h3><ul>{linked(4)}</ul></aside>", lambda: f'<div class="sidebar"><p>{said(5, 40)}</p></div>', lambda: f'<div class="comments"><h3>{said(1, 2, "")}</h3><div class="comment"><p>{said(5, 60)}</p></div><div class="comment"><p>{said(3, 30)}</p></div></div>',
        lambda: f'<section id="comments"><p>{said(10, 50)}</p></section>', lambda: f'<div class="related"><ul>{linked(3)}</ul></div>', lambda: f"<footer>&copy; 2024 {said(3, 12)}</footer>", lambda: f'<div class="footer"><p>{said(4, 20)}</p></div>', lambda: f'<form class="newsletter"><p>{said(5, 15)}</p></form>',
    ]
    out = []
    for _ in range(n):
        text = f"<h1>{said(3, 9, '')}</h1>"
        for _ in range(r.randint(2, 12)):
            text += r.choice([f"<p>{said(15, 90)}</p>", f"<p>{said(1, 12)}</p>", f"<h2>{said(1, 6, '')}</h2>", f"<ul><li>{said(3, 20)}</li><li>{said(3, 20)}</li></ul>", f"<blockquote>{said(8, 40)}</blockquote>"])
            if r.random() < 0.15:
                text += r.choice(around[3:5])()
        top = "".join(f() for f in r.sample(around, r.randint(1, 4)))
        low = "".join(f() for f in r.sample(after, r.randint(1, 4)))
        start, end = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div role=main>", "</div>")])
        out.append(f"<html><body>{top}{start}{text}{end}{low}</body></html>")
    return out


class Field:
    """Weights of features by label, of transitions and of the first label; labels are 0 (rest) and 1 (article)."""

    def __init__(self) -> None:
        self.w = np.zeros((len(FEATURES), 2))
        self.t = np.zeros((2, 2))
        self.s = np.zeros(2)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient ascent on the mean log-likelihood of the labels, with per-weight rates."""
        pages = [(x, y) for x, y in pages if len(x)]
        pages += [(np.where(np.isin(np.arange(len(FEATURES)), GIVEN), 0.0, x), y) for x, y in pages]
        if not pages:
            return
        total = sum(len(y) for _, y in pages)
        past = [np.full_like(p, 1e-8) for p in (self.w, self.t, self.s)]
        for _ in range(steps):
            grads = [np.zeros_like(p) for p in (self.w, self.t, self.s)]
            for x, y in pages:
                e = x @ self.w
                p, pairs = self._marginals(e)
                grads[0] += x.T @ (np.eye(2)[y] - p)
                np.add.at(grads[1], (y[:-1], y[1:]), 1.0)
                grads[1] -= pairs
                grads[2] += np.eye(2)[y[0]] - p[0]
            for p, g, h in zip((self.w, self.t, self.s), grads, past, strict=True):
                g = g / total - decay * p
                h += g * g
                p += rate * g / np.sqrt(h)

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(e), np.exp(self.t)
        b = np.exp(e - e.max(axis=1, keepdims=True))
        alpha, beta = np.empty((n, 2)), np.ones((n, 2))
        alpha[0] = b[0] * np.exp(self.s)
        alpha[0] /= alpha[0].sum()
        for i in range(1, n):
            alpha[i] = (alpha[i - 1] @ m) * b[i]
            alpha[i] /= alpha[i].sum()
        for i in range(n - 2, -1, -1):
            beta[i] = m @ (b[i + 1] * beta[i + 1])
            beta[i] /= beta[i].sum()
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        pairs = alpha[:-1, :, None] * m[None] * (b[1:] * beta[1:])[:, None, :]
        return p, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if n > 1 else np.zeros((2, 2))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most probable labels (Viterbi)."""
        if not len(x):
            return np.empty(0, np.int64)
        e = (x @ self.w).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = e[0][0] + self.s[0], e[0][1] + self.s[1]
        back = []
        for e0, e1 in e[1:]:
            to0, to1 = b + t10 > a + t00, b + t11 > a + t01
            back.append((to0, to1))
            a, b = (b + t10 if to0 else a + t00) + e0, (b + t11 if to1 else a + t01) + e1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


def train(pages: DataFrame, page: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """A field trained on at most `sample` pages. Equal pages are drawn together and count once, so neither nulls in other
    columns nor repeated rows make the draw larger; the rows of the draw are cut at `sample` before they reach the driver."""
    total = pages.count()
    drawn = pages.where(F.length(page) <= longest).select(F.xxhash64(page).alias("mark"), F.col(page).alias("page"))
    draw = F.shiftrightunsigned("mark", 11) / F.lit(float(2**53))
    few = drawn.where(draw < min(1.0, 8 * sample / max(1, total))).groupBy("mark").agg(F.min("page").alias("page"))
    known = [got for r in few.orderBy(F.shiftrightunsigned("mark", 11), "mark").limit(sample).collect() if (got := labelled(r["page"])) is not None]
    field = Field()
    field.train(known + [got for x in layouts() if (got := labelled(x)) is not None])
    return field


def extract(pages: DataFrame, field: Field, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row of pages: the columns to keep, text and n_chars."""
    common.lean(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field)
    rows = pages.select(*keep, page)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                texts = []
                for source in c.column(page).to_pylist():
                    got = parse(source or "")
                    texts.append("\n\n".join(t for t, y in zip(got.texts, own.decode(matrix(got.bits)), strict=True) if y))
                yield pa.RecordBatch.from_arrays([*(c.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
