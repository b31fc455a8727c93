"""HTML main-text extraction: a linear-chain CRF over the leaf blocks of the DOM.

A page is parsed into its blocks of text in page order. Each block has features of its ancestors
(tags, words of class, id and role) and of its text (length, link share, punctuation, telling
words). The chain's two labels are article and other; weights are trained by stochastic gradient on
labelled pages (``training_pages``), and Viterbi picks the labels of a page together.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, steps, table

# Fixed values of the HTML format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title iframe textarea".split())
HIDDEN = RAW | frozenset("noscript template svg object audio video canvas select button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SECTIONS = frozenset("article aside body footer form header main nav section".split())
ITEMS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SHUT = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_ENDS = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>?", re.I) for t in HIDDEN - RAW}
#: Words that tell menus, notices, adverts and comments from articles.
TELLING = frozenset(
    "accept account ad ads advertisement advertise agree archive author categories click comment comments contact consent cookie cookies copyright "
    "download email follow follower free home imprint impressum join like login logout mehr menu more newsletter next password policy post posted "
    "previous privacy read register related reply reserved rights search settings share shop sign site sponsored subscribe tags terms trending tweet "
    "username website welcome".split()
)


class Node:
    """An open element: features that no ancestor has, and what a block below it takes from its
    ancestors: the nearest tag that is not inline, and the nearest element with telling names."""

    __slots__ = ("fresh", "near", "parent", "score", "tag", "top")

    def __init__(self, tag: str, own: tuple[str, ...], parent: Node | None, fresh: tuple[str, ...]):
        self.tag, self.parent, self.fresh, self.score = tag, parent, fresh, None
        self.top = tag if tag not in INLINE else parent.top if parent else "none"
        self.near = own if len(own) > 1 or tag in SECTIONS else parent.near if parent else ()


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, linked: float, node: Node | None):
        self.text, self.linked, self.node = text, linked, node


def _own(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of one element for itself and all below it."""
    out = ["in:" + tag]
    for name, a, b, c in _ATTR.findall(attrs) if "=" in attrs else ():
        out += ["is:" + w for w in _WORD.findall((a or b or c).lower())] if name else []
    return tuple(out)


def _pairs(page: str, tag: str) -> dict[int, int]:
    """Where each element of a tag that is closed begins, and where its closing tag ends."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for m in _ENDS[tag].finditer(page):
        if not m[1]:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; tags of inline elements and comments don't end a block.

    Hidden elements and form controls have no text. One that is never closed is passed over as a tag,
    but script, style, title, iframe and textarea run to the page's end then. The work grows with the
    page's length, however deeply its elements are nested.
    """
    out: list[Block] = []
    stack: list[Node] = []
    held: Counter[str] = Counter()  # features of the open elements, and the tags of these
    parts: list[str] = []
    closing: dict[str, dict[int, int]] = {}
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(1.0, linked / len(text)), stack[-1] if stack else None))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        if any(x.tag not in INLINE for x in stack[k:]):
            flush()
        for x in stack[k:]:
            held.subtract((*x.fresh, x.tag))
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        i = page.find("<", at)
        i = end if i < 0 else i
        if i > at:
            parts.append(page[at:i])
            linked += (i - at) * (held["a"] > 0)
        if i == end:
            break
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = end if j < 0 else j + 3
            continue
        m = _TAG.match(page, i) or _LOOSE.match(page, i)
        if not m:
            if page[i + 1 : i + 2] in ("!", "?", "/"):
                j = page.find(">", i)
                at = end if j < 0 else j + 1
            elif page[i + 1 : i + 2].isalpha():  # a tag that the page's end cuts off
                at = end
            else:
                parts.append("<")
                at = i + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if held[tag] > 0:
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            shut = _SHUT[tag].search(page, at)
            at = shut.end() if shut else end
            continue
        if tag in HIDDEN:
            if not m[3].endswith("/"):
                if tag not in closing:
                    closing[tag] = _pairs(page, tag)
                at = max(at, closing[tag].get(i, at))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P and held["p"] > 0:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        ends = ("td", "th", "tr") if tag == "tr" else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
        if tag in ITEMS and any(held[x] > 0 for x in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ITEMS[tag]:
                    break
                if stack[k].tag in ends:
                    pop_to(k)
                    break
        if tag not in INLINE:
            flush()
        if tag in VOID or m[3].endswith("/"):
            continue
        own = _own(tag, m[3])
        fresh = tuple(f for f in dict.fromkeys(own) if not held[f])
        stack.append(Node(tag, own, stack[-1] if stack else None, fresh))
        held.update((*fresh, tag))
    flush()
    return out


def text_features(page: list[Block]) -> list[set[str]]:
    """Names of the features that hold for each block by its text, place and nearest elements."""
    out = []
    n = len(page)
    for i, b in enumerate(page):
        own = {"bias"}
        tag = b.node.top if b.node else "none"
        own.add("tag:" + tag)
        own.update("near:" + f for f in (b.node.near if b.node else ()))
        text = b.text
        words = text.split()
        size = min(8, int(math.log2(1 + len(words))))
        own.add(f"words:{size}")
        own.add(f"tag:{tag}:{size // 2}")
        own.add(f"linked:{round(b.linked * 4)}")
        stops = text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
        own.add(f"stops:{min(4, stops)}")
        own.add(f"commas:{min(4, text.count(','))}")
        own.add(f"place:{4 * i // n}")
        if len(words) <= 40:
            own.update("says:" + w for w in _WORD.findall(text.lower()) if w in TELLING)
        if "©" in text or "(c)" in text[:80].lower():
            own.add("says:©")
        if "|" in text or "»" in text or "·" in text:
            own.add("says:|")
        out.append(own)
    return out


def features(page: list[Block]) -> list[set[str]]:
    """Names of all features that hold for each block, those of its ancestors too."""
    out = text_features(page)
    for own, b in zip(out, page, strict=True):
        node = b.node
        while node:
            own.update(node.fresh)
            node = node.parent
    return out


class Chain:
    """Linear-chain CRF with labels 0 (other) and 1 (article)."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}
        self.t = [0.0, 0.0, 0.0, 0.0]  # 00 01 10 11

    def emissions(self, page: list) -> list[float]:
        w = self.w
        return [sum(w.get(f, 0.0) for f in own) for own in page]

    def scores(self, page: list[Block]) -> list[float]:
        """Emissions of the blocks of one page; what ancestors add is summed once for each element."""
        w, out = self.w, self.emissions(text_features(page))
        for i, b in enumerate(page):
            node, path = b.node, []
            while node and node.score is None:
                path.append(node)
                node = node.parent
            above = node.score if node else 0.0
            for node in reversed(path):
                above = node.score = above + sum(w.get(f, 0.0) for f in node.fresh)
            out[i] += above
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        a, b, c, d = self.t
        x, y, back = 0.0, scores[0], []
        for s in scores[1:]:
            p, q = x + a >= y + c, x + b > y + d
            back.append((0 if p else 1, 0 if q else 1))
            x, y = (x + a if p else y + c), (x + b if q else y + d) + s
        out = [int(y > x)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def gradient(self, scores: list[float], labels: list[int]) -> tuple[list[float], list[float]]:
        """Expected less observed: article marginals less labels, and transition counts."""
        t, n = self.t, len(scores)
        e = [(1.0, math.exp(max(-30.0, min(30.0, s)))) for s in scores]
        m = [math.exp(v) for v in t]
        alpha = [(1.0 / (1 + e[0][1]), e[0][1] / (1 + e[0][1]))]
        for i in range(1, n):
            x, y = alpha[-1]
            p, q = (x * m[0] + y * m[2]) * e[i][0], (x * m[1] + y * m[3]) * e[i][1]
            alpha.append((p / (p + q), q / (p + q)))
        beta = [(1.0, 1.0)] * n
        for i in range(n - 2, -1, -1):
            u, v = e[i + 1][0] * beta[i + 1][0], e[i + 1][1] * beta[i + 1][1]
            p, q = m[0] * u + m[1] * v, m[2] * u + m[3] * v
            beta[i] = (p / (p + q), q / (p + q))
        node, edge = [], [0.0] * 4
        for i in range(n):
            p, q = alpha[i][0] * beta[i][0], alpha[i][1] * beta[i][1]
            node.append(q / (p + q) - labels[i])
            if i:
                own = [alpha[i - 1][j // 2] * m[j] * e[i][j % 2] * beta[i][j % 2] for j in range(4)]
                z = sum(own)
                for j in range(4):
                    edge[j] += own[j] / z
                edge[labels[i - 1] * 2 + labels[i]] -= 1
        return node, edge

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.25, decay: float = 2e-3) -> Chain:
        """AdaGrad over pages, features weighted alike, with an L2 pull on the weights touched."""
        seen: dict[str, float] = {}
        rng, sums = random.Random(11), [1e-3] * 4
        for _ in range(epochs):
            rng.shuffle(pages)
            for own, labels in pages:
                node, edge = self.gradient(self.emissions(own), labels)
                grad: dict[str, float] = {}
                for g, names in zip(node, own, strict=True):
                    if abs(g) > 1e-4:
                        for f in names:
                            grad[f] = grad.get(f, 0.0) + g
                for f, g in grad.items():
                    w = self.w.get(f, 0.0)
                    g += decay * w
                    seen[f] = seen.get(f, 1e-3) + g * g
                    self.w[f] = w - rate * g / math.sqrt(seen[f])
                for j in range(4):
                    sums[j] += edge[j] ** 2
                    self.t[j] -= rate * edge[j] / math.sqrt(sums[j])
        return self


# ---------------------------------------------------------------- labelled training pages

_CONTENT = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'section class="article-body"', 'div role="main"', 'div class="story text"', 'div itemprop="articleBody"', "div", 'td class="body"']
_NOISE = {
    "menu": ["nav", 'ul class="menu"', 'div id="nav"', 'div class="navbar navigation"', 'div class="breadcrumb"', 'div role="navigation"', 'div class="topbar links"'],
    "head": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-title logo"', 'div role="banner"'],
    "foot": ["footer", 'div class="footer"', 'div id="colophon"', 'div class="copyright legal"', 'div role="contentinfo"'],
    "side": ["aside", 'div class="sidebar"', 'div id="right-column" class="widget"', 'div class="related links"', 'section class="recommended teaser"', 'div role="complementary"', 'div class="author-bio"', 'div class="tags"', 'div class="share social"', 'div class="pagination"'],
    "note": ['div class="cookie-notice"', 'div id="cookie-banner"', 'div class="consent gdpr"', 'div class="notice alert"', 'div class="newsletter popup"', 'div role="alert"', 'div role="dialog" class="modal"', 'p class="disclaimer"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad-top"', 'div class="banner sponsored"', 'div class="promo"', 'ins class="adsbygoogle ad"', 'aside class="ad"'],
    "form": ["form", 'form class="search"', 'form id="login"', 'div class="subscribe form"'],
    "talk": ['section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="discussion replies"', 'section id="reader-comments"', 'div class="comment-thread responses"'],
}
_SAYS = {
    "menu": ["Home", "About", "Contact", "Archive", "News", "Login", "Shop"],
    "head": ["Welcome", "The daily site", "Menu", "Search this site"],
    "foot": ["© All rights reserved", "Privacy policy", "Terms", "Imprint", "Copyright"],
    "side": ["Related posts", "Read more", "Share", "Tags:", "Trending", "Follow us", "Next", "Previous"],
    "note": ["We use cookies. Accept", "This site uses cookies to improve your experience.", "Subscribe to our newsletter", "Please agree to our privacy policy."],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Click here for free shipping"],
    "form": ["Email", "Password", "Search", "Sign in", "Submit", "Your name"],
    "talk": ["Reply", "Comments", "Posted by", "Like"],
}


def training_pages(n: int = 500, seed: int = 4) -> Iterator[tuple[str, set[str]]]:
    """Labelled pages: html and the texts of its article's blocks (every text is unique)."""
    rng = random.Random(seed)
    used = 0

    def prose(low: int, high: int) -> str:
        nonlocal used
        used += 1
        out = [f"w{used}q"]
        for _ in range(rng.randint(low, high)):
            out.append("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "la", "ch", "ei", "é", "ü"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", "", "", ",", "."]))
        join, end = rng.choices([(" ", "."), (" ", ""), (" | ", " |"), ("### ", "***"), ("!! ", "!!")], [60, 25, 5, 5, 5])[0]
        return join.join(out).capitalize() + end

    def wrap(opening: str, body: str) -> str:
        return f"<{opening}>{body}</{opening.split()[0]}>"

    def link() -> str:
        nonlocal used
        used += 1
        return f'<a href="/{used}">{rng.choice(_SAYS["menu"])} w{used}</a>'

    def noise(kind: str) -> str:
        opening = rng.choice(_NOISE[kind])
        says = lambda: f"{rng.choice(_SAYS[kind])} {prose(0, 8)}" if rng.random() < 0.6 else prose(2, 18)
        if kind == "menu":
            items = [link() for _ in range(rng.randint(2, 7))]
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if not opening.startswith("ul") and rng.random() < 0.7 else "".join(f"<li>{x}</li>" for x in items) if opening.startswith("ul") else " | ".join(items)
        elif kind == "form":
            body = "".join(f"<label>{says()}</label><input name=q>" for _ in range(rng.randint(1, 3))) + f"<button>{prose(0, 1)}</button>"
            body += f"<select><option>{prose(0, 2)}<option>{prose(0, 2)}</select>" if rng.random() < 0.3 else ""
        elif kind == "talk":
            one = lambda: rng.choice([f'<div class="comment"><p>{prose(4, 50)}</p></div>', f"<li>{says()}<p>{prose(6, 60)}</p></li>", f"<p>{prose(5, 40)}</p>", f'<article class="comment"><p>{prose(5, 40)}</p></article>'])
            body = (f"<h3>{says()}</h3>" if rng.random() < 0.7 else "") + "".join(one() for _ in range(rng.randint(1, 5)))
        elif kind == "side":
            body = (f"<h3>{says()}</h3>" if rng.random() < 0.6 else "") + rng.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>", f"<p>{prose(3, 30)}</p>", says()])
        elif kind == "head":
            body = rng.choice([f"<h1>{prose(1, 3)}</h1>", f"<p>{says()}</p>", says(), f"<a href='/'>{prose(0, 2)}</a>"])
        else:
            body = rng.choice([says(), f"<p>{says()}</p>", f"<p>{prose(8, 40)}</p>", f"<span>{says()}</span> {link()}"])
        return wrap(opening, body) if not (opening.startswith("p ") and "<p" in body) else f"<{opening}>{says()}</p>"

    for _ in range(n):
        article: set[str] = set()

        def keep(text: str, article: set[str] = article) -> str:
            article.add(" ".join(text.split()))
            return text

        body = []
        if rng.random() < 0.85:
            body.append(f"<h1>{keep(prose(1, 9))}</h1>")
        for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
            x = rng.random()
            if x < 0.04:
                used += 1
                body.append(f"<p>{keep(rng.choice(_SAYS[rng.choice(sorted(_SAYS))]) + f' w{used}')}</p>")
            elif x < 0.72:
                open_ = rng.choice(["<p>", "<p>", "<p>", "<p><b>", '<p class="lead">'])
                body.append(f"{open_}{keep(prose(0, 70))}" + rng.choice(["</p>", "</p>", "<br>"]))
            elif x < 0.8:
                body.append(f"<h2>{keep(prose(1, 6))}</h2>")
            elif x < 0.87:
                body.append("<ul>" + "".join(f"<li>{keep(prose(2, 15))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif x < 0.91:
                body.append(f"<blockquote>{keep(prose(5, 30))}</blockquote>")
            elif x < 0.95:
                body.append(f"<table><tr><td>{keep(prose(0, 4))}<td>{keep(prose(0, 4))}</table>")
            elif x < 0.98:
                body.append(noise(rng.choice(["ad", "ad", "side", "note", "form"])))
            else:
                body.append(f"<pre>{keep(prose(3, 20))}</pre>")
        main = wrap(rng.choice(_CONTENT[:4] if rng.random() < 0.5 else _CONTENT), "".join(body))
        if rng.random() < 0.25:
            main = wrap(rng.choice(["div", 'div id="page"', 'div class="wrapper container"', "main", 'div class="row"']), main)
        before = [noise(k) for k in ("note", "head", "menu", "form", "ad", "side") if rng.random() < 0.45]
        after = [noise(k) for k in ("ad", "side", "talk", "form", "note", "foot", "foot") if rng.random() < 0.45]
        rng.shuffle(before)
        yield f"<html><head><title>{prose(1, 5)}</title><style>p{{}}</style></head><body>" + "".join(before) + main + "".join(after) + "</body></html>", article


def labelled(page: str, article: set[str]) -> tuple[list[list[str]], list[int]]:
    found = blocks(page)
    return [sorted(f) for f in features(found)], [int(b.text in article) for b in found]


@functools.lru_cache(2)
def trained(n: int = 500) -> Chain:
    return Chain().fit([x for x in (labelled(*p) for p in training_pages(n)) if x[1]])


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    keep = chain.viterbi(chain.scores(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """``pages`` (html, any columns) with ``text``, the article's blocks in page order joined by
    newlines, and ``n_chars``, its code points.

    Null or empty html, and pages without an article, give an empty text. Columns named text or
    n_chars are replaced. Repeated rows give equal rows, an empty table an empty result. Row by row,
    whole pages, no shuffle.
    """
    sent = Sent(pages.sparkSession, chain or trained())
    pages = pages.drop("text", "n_chars")
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, htmls in steps(batch, "html"):
                texts = [main_text(p, sent.value) for p in htmls.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    own = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.mapInArrow(run, T.StructType(pages.schema.fields + own))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.col("n_chars"))
