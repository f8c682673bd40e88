"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is read into a tree of block elements (inline elements belong to the block around them; scripts, styles, the
head and form controls never count). Each block has features of itself, its subtree, its attribute tokens, its depth
and its siblings; boosted trees give the odds that its subtree holds any main text. A block can only be kept if its
parent is, so the kept blocks are the connected set from the root with the greatest sum of log odds, found in two
passes over the tree: no kept child inside a dropped parent, and a doubtful wrapper stays for the sake of what it holds.

The trees are fitted here, on TRAIN_PAGES pages of a generator of page layouts with known main text (a bounded,
documented sample; fixed seed), with histogram splits and logistic loss.

Defined results: null html counts as empty; no main text gives an empty string. A page that the parser finds no tag in
is text of its own and kept. Unclosed and stray tags are tolerated: an unclosed script, style, iframe, textarea or xmp
holds all that follows, any other element ends with its parent. Reading takes linear time, whatever is left open. Null page_id or url are carried. Repeated rows: one
result row each. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 1000
TREES, DEPTH, RATE, BINS, L2, MIN_HESSIAN = 40, 4, 0.3, 32, 1.0, 2.0

OPEN = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'|[<\"']")
ATTR = re.compile(r"(?:class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LABEL = re.compile(r"data-y\s*=\s*\"?([01])", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea xmp".split())
NEVER = RAW | frozenset("noscript template svg head title button select option datalist object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img input".split())
#: A start tag of the first kind ends an open element of the second.
P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG_KINDS = [
    "html body",
    "article main",
    "section div center",
    "p pre blockquote figcaption",
    "h1 h2 h3 h4 h5 h6",
    "nav menu",
    "header",
    "footer",
    "aside",
    "form fieldset legend",
    "ul ol dl",
    "li dt dd",
    "table tbody thead tfoot tr td th caption",
    "figure",
]
KIND = {t: i for i, k in enumerate(TAG_KINDS) for t in k.split()}
#: Tokens of class, id and role, by what they tell.
TOKENS = [
    "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs",
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion adsense",
    "cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe subscription paywall dialog",
    "comment comments reply replies discussion disqus respond feedback",
    "sidebar aside widget widgets related share sharing social recommended trending popular complementary",
    "footer copyright legal credits colophon contentinfo bottom",
    "header masthead topbar logo branding top",
    "form login signup search register contact",
    "article content post entry main story body text news blog prose",
]
SIGN = {t: i for i, k in enumerate(TOKENS) for t in k.split()}
N_KIND, N_SIGN = len(TAG_KINDS), len(TOKENS)
MARKS = re.compile(r"[.,;:!?]")


def tags(source: str) -> Iterator[tuple[int, int, str | None, str | None, str]]:
    """(start, end, name of an end tag, name of a start tag, attributes) of each tag and comment, in linear time.

    An attribute's quotes may hold a `>`. Where they never close, the tag ends at the first `>`; all `<` that were met
    outside quotes on the way to the source's end would fare the same, and are remembered. A tag without any `>` is text.
    """
    at, last, doomed = 0, source.rfind(">"), set()
    while (i := source.find("<", at)) >= 0:
        c = source[i + 1 : i + 2]
        if c in ("!", "?"):
            mark = "-->" if source.startswith("<!--", i) else ">"
            j = source.find(mark, i + 4 if mark == "-->" else i)
            at = j + len(mark) if j >= 0 else len(source)
            yield i, at, None, None, ""
            continue
        m = None
        if i < last and c == "/":
            m = END.match(source, i)
        elif i < last and c.isascii() and c.isalpha():
            m = None if i in doomed else OPEN.match(source, i)
            if not m:
                if i not in doomed:
                    for q in QUOTED.finditer(source, i):
                        if q[0] == "<":
                            doomed.add(q.start())
                        elif len(q[0]) == 1:
                            break
                m = PLAIN.match(source, i)
        if not m:
            at = i + 1
            continue
        at = m.end()
        yield (i, at, m[1], None, "") if c == "/" else (i, at, None, m[1], m[2])


class Page:
    """Blocks of a page in document order, and its runs of text.

    runs: (block, text or None); None marks a boundary between blocks of text.
    """

    __slots__ = ("labels", "parent", "runs", "signs", "tags", "links")

    def __init__(self, source: str):
        self.tags, self.parent, self.signs, self.labels = ["html"], [-1], [()], [None]
        self.runs: list[tuple[int, str | None]] = []
        self.links: list[int] = [0]
        stack: list[tuple[str, int]] = [("html", 0)]  # every open element and its block
        blocks = [0]  # places in the stack of what is not inline
        open_: dict[str, int] = {"html": 1}
        dead = links = 0  # open elements that never count, open anchors
        at = skip = 0

        def pop_to(k: int) -> None:
            nonlocal dead, links
            block = False
            while len(stack) > k:
                t, own = stack.pop()
                open_[t] -= 1
                dead -= t in NEVER
                links -= t == "a"
                if t not in INLINE:
                    block |= t != "svg" and (t in NEVER or own != stack[-1][1])
                    blocks.pop()
            if block:
                self.runs.append((stack[-1][1], None))

        def say(text: str) -> None:
            if text and not dead:
                self.runs.append((stack[-1][1], text))
                if links:
                    self.links[stack[-1][1]] += len(text)

        for start, after, end, tag, attrs in tags(source):
            if start < skip:
                continue
            say(source[at:start])
            at = after
            if end:
                end = end.lower()
                if open_.get(end, 0) and len(stack) > 1:
                    k = len(stack) - 1
                    while stack[k][0] != end:
                        k -= 1
                    if k:
                        pop_to(k)
                continue
            if not tag:
                continue
            tag = tag.lower()
            if tag in VOID:
                self.runs.append((stack[-1][1], " " if tag != "hr" else None)) if not dead else None
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}[\s>/]", re.I).search(source, at)
                if not close:  # what follows is all of its text
                    at = skip = len(source)
                    break
                at = skip = source.find(">", close.start()) + 1 or len(source)
                continue
            if tag == "html" or (tag == "svg" and attrs.endswith("/")):
                continue
            if tag in P_ENDS and open_.get("p", 0) and stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
            if tag in LIKE:
                j = len(blocks) - 1
                while j and stack[blocks[j]][0] == "p":
                    j -= 1
                while j and stack[blocks[j]][0] in LIKE[tag]:
                    pop_to(blocks[j])
                    j = len(blocks) - 1
                    while j and stack[blocks[j]][0] == "p":
                        j -= 1
            if tag == "body" and open_.get("head", 0):
                pop_to(next(i for i, s in enumerate(stack) if s[0] == "head"))
            block = stack[-1][1]
            if tag not in INLINE and tag not in NEVER and not dead:
                self.tags.append(tag)
                self.parent.append(block)
                values = [x or y or z for x, y, z in ATTR.findall(attrs)] if attrs else ()
                self.signs.append(tuple(SIGN[w] for v in values for t in TOKEN.findall(v) if (w := t.lower()) in SIGN))
                label = LABEL.search(attrs) if attrs else None
                self.labels.append(int(label[1]) if label else None)
                self.links.append(0)
                block = len(self.tags) - 1
                self.runs.append((block, None))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append((tag, block))
            open_[tag] = open_.get(tag, 0) + 1
            dead += tag in NEVER
            links += tag == "a"
        say(source[at:])

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parent = self.parent
        chars, words, marks, tags, paras, links = ([0] * n for _ in range(6))
        for i, text in self.runs:
            if text:
                chars[i] += len(text)
                words[i] += text.count(" ") + 1
                marks[i] += len(MARKS.findall(text))
        depth, kids, seen, same = [0] * n, [0] * n, [{} for _ in range(n)], [0] * n
        order, ties = [0] * n, [0] * n
        up_bad, up_good, up_kind = [0] * n, [0] * n, [0] * n
        bad = [0] * n
        for i in range(n):
            kind, signs = KIND.get(self.tags[i], -1), self.signs[i]
            bad[i] = sum(s < N_SIGN - 1 for s in signs) + (5 <= kind <= 9)
            good = sum(s == N_SIGN - 1 for s in signs) + (kind == 1)
            links[i] = self.links[i]
            if i:
                p = parent[i]
                depth[i], order[i] = depth[p] + 1, kids[p]
                kids[p] += 1
                ties[i] = seen[p].get(self.tags[i], 0)
                seen[p][self.tags[i]] = ties[i] + 1
                up_bad[i], up_good[i], up_kind[i] = up_bad[p] + (bad[p] > 0), up_good[p] + good_of[p], KIND.get(self.tags[p], -1)
            else:
                good_of = [0] * n
            good_of[i] = int(good > 0)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            paras[i] += self.tags[i] == "p"
            for x in (chars, words, marks, links, paras):
                x[p] += x[i]
            tags[p] += tags[i] + 1
        x = np.zeros((n, N_KIND + N_SIGN + 18), np.float32)
        for i in range(n):
            if (k := KIND.get(self.tags[i], -1)) >= 0:
                x[i, k] = 1
            for s in self.signs[i]:
                x[i, N_KIND + s] += 1
            p = max(parent[i], 0)
            same[i] = seen[p].get(self.tags[i], 0)
        a = lambda v: np.asarray(v, np.float32)
        c, t = a(chars), a(tags)
        up = np.maximum(a(parent), 0).astype(int)
        rest = [
            np.log1p(c), np.log1p(a(words)), c / (t + 1), a(marks) / (c + 1), a(links) / (c + 1), np.log1p(t), np.log1p(a(paras)),
            a(depth), a(kids), a(order), a(kids)[up] - a(order), a(same), c / (c[up] + 1), c / (c[0] + 1),
            a(up_bad), a(up_good), a(up_kind), a(bad),
        ]
        x[:, N_KIND + N_SIGN :] = np.column_stack(rest)
        return x

    def decode(self, odds: np.ndarray) -> list[bool]:
        """The blocks to keep: the best connected set from the root by the sum of log odds."""
        n = len(self.tags)
        best = odds.tolist()
        for i in range(n - 1, 0, -1):
            if best[i] > 0:
                best[self.parent[i]] += best[i]
        keep = [best[0] > 0] * n
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and best[i] > 0
        return keep

    def text(self, keep: list[bool]) -> str:
        blocks, own = [], []

        def close():
            if own and (line := " ".join("".join(own).split())):
                blocks.append(line)
            own.clear()

        for i, t in self.runs:
            if t is None:
                close()
            elif keep[i]:
                own.append(entities.unescape(t) if "&" in t else t)
        close()
        return "\n".join(blocks)


class Trees:
    """Boosted regression trees of one depth in arrays; margins are log odds."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(x.shape[0], self.base), np.arange(x.shape[0])
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(x.shape[0], np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Histogram gradient boosting with logistic loss; deterministic."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    p0 = y.mean()
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(y.size, base)
    inner = 2**DEPTH - 1
    fs, cs, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(y.size, np.int64)
        for d in range(DEPTH):
            first, width = 2**d - 1, 2**d
            gain = np.full((width, x.shape[1]), 1e-6)
            place = np.zeros((width, x.shape[1]), np.int64)
            for j in range(x.shape[1]):
                key = (at - first) * BINS + binned[:, j]
                gl = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hl = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                s = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                s[(hl < MIN_HESSIAN) | (ht - hl < MIN_HESSIAN)] = 0
                s = s[:, : len(cuts[j])]
                if s.shape[1]:
                    place[:, j] = s.argmax(1)
                    gain[:, j] = s.max(1)
            for k in range(width):
                j = int(gain[k].argmax())
                if gain[k, j] > 1e-5:
                    feature[first + k], cut[first + k] = j, cuts[j][place[k, j]]
            at = 2 * at + 1 + (x[np.arange(y.size), feature[at]] > cut[at])
        leaf = at - inner
        v = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        margin += v[leaf]
        fs.append(feature), cs.append(cut), vs.append(v)
    return Trees(base, np.array(fs), np.array(cs), np.array(vs))


def made_page(rng: random.Random) -> tuple[str, str]:
    """(html, main text) of a random layout; data-y marks blocks whose subtree holds main text."""
    vocab = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    words = lambda a, b: " ".join(rng.choice(vocab) for _ in range(rng.randint(a, b)))
    cap = lambda s: s[:1].upper() + s[1:]
    lines: list[str] = []

    def prose(a=1, b=120) -> str:
        kind = rng.random()
        if kind < 0.06:
            return cap(words(1, 3)) + "."
        if kind < 0.12:
            return " | ".join(words(1, 1) for _ in range(rng.randint(3, 40)))
        if kind < 0.18:
            return "!! ".join(words(1, 1).upper() for _ in range(rng.randint(3, 40)))
        s, n = [], rng.randint(a, b)
        while n > 0:
            k = min(n, rng.randint(2, 14))
            s.append(cap(words(k, k)) + rng.choice([".", ".", ".", ",", "!", "?"]))
            n -= k
        return " ".join(s)

    def block(tag: str, text: str, attrs: str = "") -> str:
        lines.append(text)
        inner = text
        if rng.random() < 0.3 and " " in text:
            a, _, b = text.partition(" ")
            inner = f"{a} <{(t := rng.choice(['b', 'em', 'a', 'span', 'strong']))}{' href=/x' if t == 'a' else ''}>{b}</{t}>"
        if tag == "p" and rng.random() < 0.15:
            return f'<p data-y="1"{attrs}><b>{text}<br>'
        return f'<{tag} data-y="1"{attrs}>{inner}</{tag}>' if not (tag == "p" and rng.random() < 0.1) else f'<p data-y="1"{attrs}>{inner}'

    def cls(*names: str) -> str:
        n = rng.choice(names)
        n = rng.choice([n, n, f"{n}-{rng.choice(['wrap', 'box', 'inner', 'area'])}", f"site-{n}", f"{n} {rng.choice(['dark', 'col', 'row'])}"])
        return f' {rng.choice(["class", "class", "id"])}="{n}"'

    def junk(tag: str, attrs: str, inner: str) -> str:
        if tag == "p":  # holds no blocks
            inner = re.sub(r"</?(?:p|div|ul|li)>", " ", inner)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    links = lambda n: "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n))
    para = lambda: rng.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<div>{}</div>", "<p>{}</p><p>{}</p>"]).replace("{}", prose(1, 40))
    nav = lambda: junk(*rng.choice([("nav", ""), ("nav", cls("menu", "navbar")), ("div", cls("nav", "menu", "breadcrumb", "navigation")), ("ul", cls("menu", "nav", "pagination"))]), f"<ul>{links(rng.randint(2, 12))}</ul>" if rng.random() < 0.7 else " &middot; ".join(f'<a href="/">{words(1, 2)}</a>' for _ in range(rng.randint(2, 8))))
    ad = lambda: junk(rng.choice(["div", "div", "aside", "section", "p"]), cls("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement"), para())
    notice = lambda: junk(rng.choice(["div", "section", "p"]), cls("cookie", "cookie-consent", "notice", "newsletter", "popup", "modal", "alert"), para() + rng.choice(["", "<button>OK</button>", f'<a href="/p">{words(1, 3)}</a>']))
    form = lambda: f"<form{rng.choice(['', cls('login', 'search', 'contact', 'subscribe')])}><label>{words(1, 3)}</label><input type=text><p>{words(1, 12)}</p><button>{words(1, 2)}</button></form>"
    side = lambda: junk(*rng.choice([("aside", ""), ("aside", cls("sidebar", "widget")), ("div", cls("sidebar", "related", "widget", "share", "social", "trending"))]), rng.choice([f"<h3>{words(1, 4)}</h3>", ""]) + rng.choice([f"<ul>{links(5)}</ul>", para(), para() + para()]))
    talk = lambda: junk(rng.choice(["div", "section", "ul", "ol", "aside"]), cls("comments", "comment-list", "discussion", "replies", "disqus"), f"<h3>{words(1, 3)}</h3>" * rng.randint(0, 1) + "".join(junk(rng.choice(["div", "article", "li"]), rng.choice(["", cls("comment", "reply")]), f"<p>{prose(1, 60)}</p>") for _ in range(rng.randint(1, 6))))
    foot = lambda: junk(*rng.choice([("footer", ""), ("footer", cls("footer")), ("div", cls("footer", "copyright", "legal", "colophon"))]), rng.choice([f"&copy; {words(1, 2)} &middot; {prose(1, 20)}", para(), f"<p>{prose(1, 25)}</p><ul>{links(3)}</ul>"]))
    head = lambda: junk(*rng.choice([("header", ""), ("header", cls("header", "masthead")), ("div", cls("header", "topbar", "logo", "masthead"))]), rng.choice([f"<h1>{words(1, 4)}</h1>", f'<a href="/">{words(1, 2)}</a>', f"<p>{words(2, 9)}</p>", nav()]))

    noise_in = lambda p: rng.choice([ad, notice, side, form, talk, nav])() if rng.random() < p else ""
    body = []
    if rng.random() < 0.9:
        body.append(block("h1", cap(words(1, 14))))
    for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 5, 8, 8, 12, 25])):
        body.append(noise_in(0.05))
        k = rng.random()
        if k < 0.78:
            body.append(block("p", prose()))
        elif k < 0.86:
            body.append(block(rng.choice(["h2", "h3"]), cap(words(1, 8))))
        elif k < 0.92:
            body.append('<ul data-y="1">' + "".join(block("li", prose(1, 25)) for _ in range(rng.randint(1, 6))) + "</ul>")
        elif k < 0.96:
            body.append('<blockquote data-y="1">' + block("p", prose(1, 40)) + "</blockquote>")
        else:
            body.append(block("pre", words(2, 30)))
    if not body or not lines:
        body.append(block("p", prose()))
    inner = "".join(body) + rng.choice(["", "", "", talk(), side(), nav(), ad()])
    wrap = rng.random()
    if wrap < 0.5:
        main = f'<article data-y="1"{rng.choice(["", "", cls("post", "article", "entry")])}>{inner}</article>'
    elif wrap < 0.65:
        main = f'<main data-y="1">{inner}</main>'
    elif wrap < 0.9:
        main = f'<div data-y="1"{cls("content", "post", "article", "entry-content", "main", "story")}>{inner}</div>'
    else:
        main = f'<div data-y="1"{cls("content", "main")}><div data-y="1">{inner}</div>{rng.choice(["", side()])}</div>'
    if rng.random() < 0.3:
        main = f'<div data-y="1"{rng.choice(["", cls("page", "container", "wrapper")])}>{rng.choice(["", nav(), ad()])}{main}{rng.choice(["", side(), talk()])}</div>'
    before = [f() for f in (head, nav, notice, ad, form) if rng.random() < 0.5]
    after = [f() for f in (ad, talk, side, form, nav, notice) if rng.random() < 0.35] + ([foot()] if rng.random() < 0.85 else [])
    rng.shuffle(before)
    page = f'<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body data-y="1">{"".join(before)}{main}{"".join(after)}'
    return page + rng.choice(["</body></html>", ""]), "\n".join(" ".join(x.split()) for x in lines)


@lru_cache(maxsize=2)
def model(pages: int = TRAIN_PAGES, seed: int = 7) -> Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(made_page(rng)[0])
        xs.append(page.features())
        ys.append(np.array([1.0 if k == 0 else float(v or 0) for k, v in enumerate(page.labels)]))
    return fit(np.concatenate(xs), np.concatenate(ys))


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    xs = [p.features() for p in pages]
    if not xs:
        return []
    margin = np.clip(trees.margin(np.concatenate(xs)), -6, 6)
    out, at = [], 0
    for p, x in zip(pages, xs, strict=True):
        own = margin[at : at + x.shape[0]]
        at += x.shape[0]
        if x.shape[0] == 1:
            own = np.ones(1)
        out.append(p.text(p.decode(own)))
    return out


def extracted(pages: DataFrame, batch: int = 256) -> DataFrame:
    """(page_id, url, text) per page."""
    trees = model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                own = b.slice(lo, batch)
                texts = main_texts(own.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
