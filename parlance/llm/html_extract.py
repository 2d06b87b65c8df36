"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the list of its leaf blocks: runs of text that no block-level tag
interrupts, with the tags, class names, ids and roles of their ancestors. A
chain over the blocks has the labels "rest" and "main"; each block's ancestor and
text features are scored, neighbours are tied by transition weights, and Viterbi
decoding picks the best label sequence. The weights are trained on labelled pages
(by default `training_pages`, made by a seeded generator of page layouts).

Scripts, styles, forms' controls and comments in the markup never become blocks. A
script, a control or another excluded element without an end tag ends at the next tag
of a block. The main blocks are joined in page order by an empty line.

Edge cases: a null or empty html, or one without text, gives the empty text; text
without any tag is one block; unclosed and stray tags are tolerated; attributes are
read as HTML has them, so that a quote inside an unquoted value closes nothing; a tag
that the page's end cuts off is text. Pages of any length and depth are read whole, in
linear time; a repeated row gets its copy's text; an empty table gives an empty table;
other columns are neither read nor returned.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import prepare

SCHEMA = "page_id long, url string, text string, n_chars long"
_COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
#: An attribute's name, and its value in quotes or up to white space. A quote that nothing closes is part of a name.
_ONE = r"""(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'>])[^\s>]++)?+)?+"""
_TAG = re.compile(rf"{_COMMENT}|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ONE})*+)>", re.S)
_LOOSE = re.compile(rf"{_COMMENT}|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_OPENS = re.compile("</?[a-zA-Z]")
_ATTR = re.compile(r"""(=?[^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Attributes whose words describe an element.
MARKS = frozenset("class id role aria-label itemprop".split())
_PART = re.compile("[a-z]+")
#: Elements whose content is no markup; all of it is left out.
RAW = frozenset("script style iframe textarea title".split())
_RAW_END = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?>", re.I | re.A) for t in RAW}
#: Elements whose content is markup that isn't text of the page.
EXCLUDED = frozenset("noscript template svg object select canvas audio video button annotation annotation-xml".split())
_EXCLUDED_START = re.compile(f"<(?:{'|'.join(sorted(EXCLUDED))})[\\s/>]", re.I | re.A)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
#: Tags of blocks, at which an excluded element without an end tag ends.
BLOCKS = frozenset("html body p div article section main aside nav header footer h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre address figure figcaption form fieldset details summary center hr".split())
#: An opening tag closes an open one of its set, within the given bounds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table article section div main aside nav header footer body td form blockquote".split())


@dataclass
class Block:
    """A leaf block: `context` names the features of its ancestors' tags and marks, `own` the rest."""

    text: str
    path: int = 0
    context: frozenset[str] = frozenset()
    linked: float = 0.0
    main: bool = False
    leaf: str = "-"
    own: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*sorted(self.context), *self.own]

    @property
    def marks(self) -> set[str]:
        return {f.removeprefix("mark=") for f in self.context if f.startswith("mark=")}


class _Page:
    """Finds a page's tags, one after another from any place, in linear time."""

    def __init__(self, html: str):
        self.html, self.pattern, self.last = html, _TAG, html.rfind(">")
        self.endless: set[str] = set()

    def after(self, at: int) -> re.Match | None:
        """The next tag or comment. From a tag on that quotes would keep open to the page's end, tags end at the next `>`."""
        while (start := self.html.find("<", at)) >= 0:
            at = start + 1
            if start > self.last and self.html[at : at + 1] not in ("!", "?"):
                continue
            m = self.pattern.match(self.html, start)
            if m is None and self.pattern is _TAG and _OPENS.match(self.html, start):
                self.pattern = _LOOSE
                m = _LOOSE.match(self.html, start)
            if m:
                return m
        return None

    def raw_end(self, tag: str, at: int) -> int | None:
        """Where the end tag of a raw element ends."""
        end = None if tag in self.endless else _RAW_END[tag].search(self.html, at)
        if end is None:
            self.endless.add(tag)
        return end and end.end()


def _excluded_ends(html: str) -> dict[int, int]:
    """Where each excluded element that has an end tag begins and ends; one that an enclosing element's end tag closes has none."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    page, at = _Page(html), 0
    while m := page.after(at):
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag or tag in VOID or (tag in INLINE and tag not in EXCLUDED):
            continue
        if m[1]:
            while held[tag]:
                name, start = stack.pop()
                held[name] -= 1
                if name == tag:
                    if tag in EXCLUDED:
                        ends[start] = at
                    break
        elif m[3].endswith("/"):
            continue
        elif tag in RAW:
            at = page.raw_end(tag, at) or at
        else:
            stack.append((tag, m.start()))
            held[tag] += 1
    return ends


class _Open:
    """An open element, with what follows from it and from all elements around it."""

    __slots__ = ("context", "hidden", "inline", "leaf", "live", "main", "path", "tag")

    def __init__(self, tag: str, outer: "_Open | None", inline: bool, names: list[str], main: bool | None, hidden: bool):
        self.tag, self.inline, self.live = tag, inline, True
        have = outer.context if outer else frozenset()
        self.context = have if have.issuperset(names) else have.union(names)
        self.main = main if main is not None else bool(outer and outer.main)
        self.hidden = hidden or bool(outer and outer.hidden)
        self.leaf = (outer.leaf if outer else "-") if inline else tag
        self.path = hash((outer.path if outer else 0, tag))


class _Stack:
    """The open elements; every question about them is answered without a walk through them."""

    def __init__(self):
        self.open: list[_Open] = []
        #: places of the open elements of each tag, of those that aren't inline, and of bounds (with cells and without)
        self.at: dict[str, list[int]] = defaultdict(list)
        self.outer: list[int] = []
        self.bounds: list[int] = []
        self.wide_bounds: list[int] = []

    @property
    def top(self) -> _Open | None:
        return self.open[-1] if self.open else None

    def push(self, x: _Open) -> None:
        k = len(self.open)
        self.open.append(x)
        self.at[x.tag].append(k)
        if not x.inline:
            self.outer.append(k)
            if x.tag in BOUNDS:
                self.bounds.append(k)
                if x.tag != "td":
                    self.wide_bounds.append(k)

    def cut(self, k: int) -> None:
        """Close all elements from place k on."""
        while len(self.open) > k:
            x = self.open.pop()
            if x.live:
                self.at[x.tag].pop()
            for places in (self.outer, self.bounds, self.wide_bounds):
                if places and places[-1] == len(self.open):
                    places.pop()

    def end_block(self, tag: str) -> None:
        if self.at[tag]:
            self.cut(self.at[tag][-1])

    def end_inline(self, tag: str) -> None:
        """Close the innermost one inside the innermost block; what it holds stays open."""
        if self.at[tag] and (not self.outer or self.at[tag][-1] > self.outer[-1]):
            self.open[self.at[tag].pop()].live = False
            k = len(self.open)
            while k and not self.open[k - 1].live:
                k -= 1
            self.cut(k)

    def close_for(self, tag: str) -> None:
        """Close what an opening tag ends."""
        closes = CLOSES.get(tag) or ({"p"} if tag not in ("html", "body") else ())
        k = max((self.at[t][-1] for t in closes if self.at[t]), default=-1)
        bounds = self.wide_bounds if tag == "tr" else self.bounds
        if k >= 0 and (not bounds or k >= bounds[-1]):
            self.cut(k)


def blocks(html: str | None, known: frozenset[str] | dict | None = None) -> list[Block]:
    """Leaf blocks in page order, their white space normalised; blocks without text are left out. Contexts hold `known` features only, where given."""
    out: list[Block] = []
    if not html:
        return out
    stack, page = _Stack(), _Page(html)
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            top = stack.top
            if text and top is None:
                out.append(Block(text))
            elif text and not top.hidden:
                out.append(Block(text, top.path, top.context, linked / len(text), top.main, top.leaf))
            parts.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if not mute:
            text = entities.unescape(raw)
            parts.append(text)
            if stack.at["a"]:
                linked += len(text.strip())

    ends = _excluded_ends(html) if _EXCLUDED_START.search(html) else {}
    at, mute = 0, False
    while True:
        m = page.after(at)
        if m is None:
            if at < len(html):
                say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if mute and tag not in RAW and tag not in EXCLUDED:
            # inside an element without an end tag
            if tag not in BLOCKS:
                continue
            mute = False
        if m[1]:
            if tag in INLINE and tag not in EXCLUDED:
                stack.end_inline(tag)
            elif tag not in EXCLUDED:
                flush()
                stack.end_block(tag)
            continue
        closed = m[3].endswith("/")
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            flush()
            if not closed:
                end = page.raw_end(tag, at)
                at, mute = end or at, end is None
            continue
        if tag in EXCLUDED:
            if tag not in ("button", "svg", "annotation", "annotation-xml"):
                flush()
            if not closed:
                at = ends.get(m.start(), at)
                mute = m.start() not in ends
            continue
        if tag == "head":
            flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            stack.close_for(tag)
        names, main, hidden = [] if inline else [f"in={tag}"], None, False
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if name == "data-main":
                    main = value == "1"
                elif name == "hidden":
                    hidden = True
                elif name == "aria-hidden":
                    hidden = hidden or value == "true"
                elif name == "style":
                    hidden = hidden or "display:none" in value.replace(" ", "")
                elif name in MARKS and tag not in ("html", "body"):
                    names += [f"mark={w}" for w in _PART.findall(value)]
        if not closed:
            stack.push(_Open(tag, stack.top, inline, names if known is None else [x for x in names if x in known], main, hidden))
    flush()
    return out


def featured(found: list[Block]) -> list[Block]:
    """Fill in the names of each block's own features."""
    n = len(found)
    for i, b in enumerate(found):
        f = ["bias", f"leaf={b.leaf}"]
        f.append("linked=" + ("no" if b.linked < 0.05 else "some" if b.linked < 0.6 else "all"))
        words = b.text.count(" ") + 1
        f.append(f"words={min(6, words.bit_length())}")
        f.append(f"stop={b.text[-1] in '.!?…:;\"”»'}")
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("copyright")
        if "|" in b.text or "»" in b.text or "·" in b.text:
            f.append("separator")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        if i and found[i - 1].path == b.path:
            f.append("as_before")
        b.own = f
    return found


class Chain:
    """Two labels, 0 for rest and 1 for main; `names` number the features, unknown ones don't count."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps
        self.table = {k: tuple(weights[i].tolist()) for k, i in names.items()}
        self.sums: dict[frozenset[str], tuple[float, float]] = {}

    def context(self, names: frozenset[str]) -> tuple[float, float]:
        """The summed weights of a context, which many blocks share."""
        got = self.sums.get(names)
        if got is None:
            if len(self.sums) > 20_000:
                self.sums.clear()
            found = [self.table[f] for f in sorted(names) if f in self.table]
            got = self.sums[names] = (sum(w[0] for w in found), sum(w[1] for w in found))
        return got

    def decode(self, found: list[Block]) -> list[int]:
        """The best label sequence, by Viterbi."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        a = b = 0.0
        back = []
        for i, block in enumerate(found):
            u, v = self.context(block.context)
            for f in block.own:
                w = self.table.get(f)
                if w:
                    u += w[0]
                    v += w[1]
            if i == 0:
                a, b = u, v
                continue
            from_a, from_b = a + s00 >= b + s10, a + s01 > b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = u + (a + s00 if from_a else b + s10), v + (a + s01 if from_b else b + s11)
        if not found:
            return []
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train(pages: list[list[Block]], rounds: int = 160, rate: float = 0.08, decay: float = 2e-3) -> Chain:
    """Maximise the conditional likelihood of the labels, with a quadratic penalty, by full-batch Adam steps."""
    pages = [featured(p) for p in pages if p]
    names: dict[str, int] = {}
    for p in pages:
        for b in p:
            for f in b.features:
                names.setdefault(f, len(names))
    n, t = len(pages), max(map(len, pages))
    at, feat, gold = [], [], np.zeros((n, t), int)
    mask = np.zeros((n, t), bool)
    for i, p in enumerate(pages):
        for j, b in enumerate(p):
            mask[i, j], gold[i, j] = True, b.main
            at += [i * t + j] * len(b.features)
            feat += [names[f] for f in b.features]
    at, feat = np.array(at), np.array(feat)
    w, s = np.zeros((len(names), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(x) for x in (w, w, s, s)]
    one_hot = np.eye(2)[gold] * mask[..., None]
    for step in range(1, rounds + 1):
        node = np.stack([np.bincount(at, w[feat, k], n * t) for k in (0, 1)], -1).reshape(n, t, 2)
        fore, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fore[:, 0] = node[:, 0]
        for j in range(1, t):
            new = np.logaddexp(fore[:, j - 1, 0, None] + s[0], fore[:, j - 1, 1, None] + s[1]) + node[:, j]
            fore[:, j] = np.where(mask[:, j, None], new, fore[:, j - 1])
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        for j in range(t - 2, -1, -1):
            x = node[:, j + 1] + back[:, j + 1]
            new = np.logaddexp(s[None, :, 0] + x[:, :1], s[None, :, 1] + x[:, 1:])
            back[:, j] = np.where(mask[:, j + 1, None], new, 0)
        prob = np.exp(fore + back - total[:, None, None]) * mask[..., None]
        pair = np.exp(fore[:, :-1, :, None] + s + (node + back)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.einsum("ija,ijb->ab", one_hot[:, :-1], one_hot[:, 1:])
        diff = (prob - one_hot).reshape(n * t, 2)
        gw = np.stack([np.bincount(feat, diff[at, k], len(names)) for k in (0, 1)], -1) / n + decay * w
        gs = (pair.sum((0, 1)) - seen) / n + decay * s
        for x, g, m, v in ((w, gw, *moments[:2]), (s, gs, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(names, w, s)


def training_pages(count: int = 500, seed: int = 20) -> list[list[Block]]:
    """Labelled pages of many layouts: the generator marks what belongs to the article with data-main="1", and what doesn't with "0"; the innermost mark counts."""
    r = random.Random(seed)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que ción ich ung eau ée ß ñ".split()

    def words(a: int, b: int) -> str:
        w = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(a, b))]
        style = r.random()
        if style < 0.08:
            w = [x.upper() + "!!" for x in w]
        elif style < 0.16:
            w = [x + r.choice(("***", "###", "&amp;&amp;&amp;", "$$$", "%%%")) for x in w]
        elif style < 0.22:
            return " | ".join(w).capitalize()
        return " ".join(w).capitalize() + r.choice(("", ".", ".", ".", "!", "?"))

    def text(short: float = 0.25) -> str:
        return words(1, 6) if r.random() < short else words(7, 90)

    def some(tag: str, a: int, b: int, make) -> str:
        return "".join(f"<{tag}>{make()}</{tag}>" for _ in range(r.randint(a, b)))

    def link() -> str:
        return f'<a href="/{r.randint(1, 999)}">{words(1, 3)}</a>'

    def div(names: str, inner: str, tags: str = "div") -> str:
        name, tag = r.choice(names.split()), r.choice(tags.split())
        return f'<{tag} {r.choice(("class", "id"))}="{name}">{inner}</{tag}>'

    def rest(make):
        """The same element, marked as no part of the article."""
        return lambda: re.sub("^<[a-z0-9]+", r'\g<0> data-main="0"', make())

    @rest
    def menu() -> str:
        inner = r.choice((f"<ul>{some('li', 2, 8, link)}</ul>", "".join(link() for _ in range(r.randint(2, 6))), some("p", 1, 4, link)))
        return r.choice((f"<nav>{inner}</nav>", div("nav menu navbar main-menu breadcrumb breadcrumbs navigation site-nav tabs pagination", inner, "div ul nav")))

    @rest
    def header() -> str:
        inner = r.choice((link(), f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 9)}</p>", words(1, 8))) + (menu() if r.random() < 0.5 else "")
        return r.choice((f"<header>{inner}</header>", div("header site-header masthead top banner branding page-header logo", inner, "div header")))

    @rest
    def footer() -> str:
        inner = r.choice((f"&copy; {words(1, 3)} &middot; {text()}", some("p", 1, 3, text), f"<ul>{some('li', 1, 5, link)}</ul>", words(2, 30)))
        return r.choice((f"<footer>{inner}</footer>", div("footer site-footer bottom copyright legal imprint colophon", inner, "div footer")))

    @rest
    def side() -> str:
        inner = r.choice((f"<h3>{words(1, 4)}</h3><ul>{some('li', 2, 6, link)}</ul>", some("p", 1, 4, text), f"<h2>{words(1, 3)}</h2><p>{text()}</p>", words(2, 30)))
        return r.choice((f"<aside>{inner}</aside>", div("sidebar side widget related related-posts teaser recommended more-stories popular trending rail", inner, "div aside section")))

    @rest
    def advert() -> str:
        inner = r.choice((text(), f"<p>{text()}</p>", link(), some("p", 1, 3, text)))
        return div("ad ads advert advertisement ad-box sponsored sponsor promo banner-ad promotion adsense", inner, "div div section aside")

    @rest
    def notice() -> str:
        inner = r.choice((text(), f"<p>{text()}</p>", f"<p>{text()}</p><button>OK</button>"))
        return r.choice((div("cookie cookie-notice cookies consent notice alert gdpr cookie-banner popup modal subscribe newsletter paywall disclaimer warning message", inner, "div div section"), f'<div role="{r.choice(("alert", "dialog", "banner"))}">{inner}</div>'))

    @rest
    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input type=text>" + r.choice(("", f"<p>{text()}</p>", words(1, 6)))
        return r.choice((f"<form>{inner}</form>", div("search login signup contact-form subscribe newsletter search-form", f"<form>{inner}</form>")))

    @rest
    def comments() -> str:
        one = lambda: div("comment comment-body reply comment-text", r.choice((f"<p>{text()}</p>", some("p", 1, 3, text), f"<b>{words(1, 2)}</b> <p>{text()}</p>", text())), "div li article section")
        inner = r.choice(("", f"<h2>{words(1, 3)}</h2>")) + r.choice(("".join(one() for _ in range(r.randint(1, 5))), some("p", 1, 5, text), f"<ol>{some('li', 1, 4, text)}</ol>"))
        return div("comments comment-list commentlist discussion responses reader-comments disqus respond", inner, "section div div ol")

    @rest
    def share() -> str:
        return div("share social share-buttons tags meta post-meta byline author toolbar", r.choice((words(1, 6), "".join(link() for _ in range(3)))))

    extras = (advert, side, share, form, notice)

    def article() -> str:
        kind = r.random()
        inner = [] if r.random() < 0.2 else [f"<h1>{words(1, 12)}</h1>"]
        for _ in range(r.randint(1, 14)):
            p = r.random()
            if p < 0.72:
                body = text()
                if r.random() < 0.15:
                    body = f"<b>{body}" + r.choice(("</b>", "<br>", ""))
                elif r.random() < 0.2:
                    body = f"{words(1, 12)} {link()} <em>{words(1, 4)}</em> {words(1, 30)}"
                inner.append(f"<p>{body}" + r.choice(("</p>", "</p>", "</p>", "")))
            elif p < 0.78:
                level = r.choice("2234")
                inner.append(f"<h{level}>{words(1, 7)}</h{level}>")
            elif p < 0.83:
                inner.append(f"<ul>{some('li', 1, 5, text)}</ul>")
            elif p < 0.86:
                inner.append(f"<blockquote>{r.choice((text(), f'<p>{text()}</p>'))}</blockquote>")
            elif p < 0.89:
                inner.append(f"<table>{some('tr', 1, 3, lambda: some('td', 1, 3, lambda: words(1, 6)))}</table>")
            elif p < 0.91:
                inner.append(f"<pre>{words(2, 30)}</pre>")
            elif p < 0.94 and kind > 0.12:
                inner.append(f'<div class="{r.choice(("text", "paragraph", "row", "section"))}">{text()}</div>')
            else:
                inner.append(r.choice(extras)())
        whole = "".join(inner)
        names = "content article post entry article-body post-content entry-content story main main-content text body-text page-content"
        return r.choice((f'<article data-main="1">{whole}</article>', f'<article data-main="1">{whole}</article>', f'<main data-main="1">{whole}</main>', f'<main><article data-main="1">{whole}</article></main>', f'<div {r.choice(("class", "id"))}="{r.choice(names.split())}" data-main="1">{whole}</div>', f'<section class="{r.choice(names.split())}" data-main="1">{whole}</section>', f'<div data-main="1">{whole}</div>'))

    pages = []
    for _ in range(count):
        before = [f() for f in (notice, header, menu, advert, form) if r.random() < 0.45]
        after = [f() for f in (side, advert, comments, form, share, notice, footer) if r.random() < 0.45]
        r.shuffle(before)
        html = "".join(before) + article() + "".join(after)
        if r.random() < 0.06:
            html = f'<div data-main="1">{some("p", 1, 6, text)}</div>'
        pages.append(blocks(f"<html><head><title>{words(1, 5)}</title></head><body>{html}" + r.choice(("</body></html>", ""))))
        if r.random() < 0.1:  # a page of text alone, or of bare paragraphs
            bare = blocks(r.choice((text(), f"<body>{text()}</body>", some("p", 1, 6, text), f"<body>{some('p', 1, 6, text)}</body>")))
            for b in bare:
                b.main = True
            pages.append(bare)
    return pages


_CHAIN: list[Chain] = []


def chain() -> Chain:
    """The default model, trained once in a process."""
    if not _CHAIN:
        _CHAIN.append(train(training_pages()))
    return _CHAIN[0]


def main_text(html: str | None, model: Chain) -> str:
    found = featured(blocks(html, model.table))
    return "\n\n".join(b.text for b, y in zip(found, model.decode(found), strict=True) if y)


def extract(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """`page_id, url, text, n_chars` of each page."""
    held = prepare(pages.sparkSession).sparkContext.broadcast(model or chain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py(), held.value) for h in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"].cast(pa.int64()), b["url"].cast(pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
