"""Main text of web pages: a recurrent block labeller over leaf sequences.

A page becomes the sequence of its text blocks, each with the tag path above it. A block's
input is a hashed tag-path vector, a hashed-word vector and a few densities; a
bidirectional LSTM written in numpy reads the whole sequence, so every block is labelled
with the context of the document, and blocks labelled as article text are joined. The
network is trained on pages drawn here (``layouts``), whose labels are known; it never sees
the pages it is applied to. The drawn pages differ in elements, names, columns, paragraphs
and comments, many have invented names or none, and the inputs of words and at times of
names are exchanged in training, so that an unknown name means nothing rather than junk.
Article text counts ``FAVOUR`` times in the loss. Pages are independent: no shuffle.

A page is read in one pass whatever its markup: open elements are found by name and not by
searching, a path shares its beginning with the paths it grew from, and the network runs
over ``STEPS`` blocks at a time, so time and memory grow with the page's length only.

Defined results: null or tagless input is one block or none; unclosed and crossed tags are
closed by the block that follows; script, style, form controls and comments never give
text; of the elements without text (``SILENT``) one that is never closed loses its tag only,
a script or style what stands before the next tag; a tag whose quoted value does not close,
or closes at the next tag's quote, ends at its first ``>``; the text of formulas is text; a
page without article blocks gives an empty text and 0 characters; repeated rows are repeated.
"""

from __future__ import annotations

import collections
import functools
import html
import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import worker_cache

TAG_DIM, NAME_DIM, WORD_DIM, EXTRA_DIM = 40, 128, 16, 6
PATH_DIM = TAG_DIM + NAME_DIM
INPUT = PATH_DIM + WORD_DIM + EXTRA_DIM
HIDDEN = 24
STEPS = 8_192
SEED = 20_240_501
FAVOUR = 3.0

# Fixed values of HTML: elements by role.
VOID = frozenset("area base br col embed head hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
SILENT = frozenset("script style noscript template textarea select option svg iframe object title annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article section div main body html table ul ol dl nav aside footer header form blockquote".split())

NAME = r"<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)"
OTHER = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
#: A tag that ends plainly, no quoted value holding a ">"; of others only the beginning.
TAG = re.compile(rf"{OTHER}|{NAME}(?:(?P<attrs>(?:[^>\"']++|\"[^\">]*+\"|'[^'>]*+')*+)>)?", re.S)
MARK = re.compile("[>\"']")
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset(("script", "style"))


class Paths:
    """Tag paths as numbers, with the summed hash vector of each, elements before names; a path is its beginning and one more label."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.sums: list[np.ndarray] = [np.zeros(PATH_DIM, np.float32)]

    def child(self, node: int, label: str) -> int:
        key = (node, label)
        if key not in self.known:
            v = self.sums[node].copy()
            tag, *names = label.split()
            k, sign = _slot(tag, TAG_DIM)
            v[k] += sign
            for word in names:
                for piece in {word, *re.split(r"[-_0-9]+", word)} - {""}:
                    k, sign = _slot(piece, NAME_DIM)
                    v[TAG_DIM + k] += sign
            self.known[key] = len(self.sums)
            self.sums.append(v)
        return self.known[key]


class _Open:
    """The open elements of a page: (name, path) in order, with the places of each name. A place closed out of order is left as a gap."""

    def __init__(self, paths: Paths | None) -> None:
        self.paths = paths
        self.names: list[str | None] = []
        self.nodes: list[int] = []
        self.places: dict[str, list[int]] = collections.defaultdict(list)
        self.scopes: list[int] = []

    @property
    def node(self) -> int:
        return self.nodes[-1] if self.nodes else 0

    def push(self, name: str, label: str) -> None:
        self.places[name].append(len(self.names))
        if name in SCOPE:
            self.scopes.append(len(self.names))
        self.nodes.append(self.paths.child(self.node, label) if self.paths else 0)
        self.names.append(name)

    def cut(self, place: int) -> None:
        """Close everything from a place on."""
        while len(self.names) > place:
            name = self.names.pop()
            self.nodes.pop()
            if name is not None:
                self.places[name].pop()
                if name in SCOPE:
                    self.scopes.pop()

    def close_one(self, name: str) -> None:
        """Close the last element of a name and nothing above it."""
        place = self.places[name].pop()
        self.names[place] = None
        while self.names and self.names[-1] is None:
            self.names.pop()
            self.nodes.pop()

    def last(self, names: Iterable[str]) -> int:
        """The place of the last element of some names that no later scope hides, or -1."""
        place = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        return place if place >= (self.scopes[-1] if self.scopes else -1) else -1


class Followed:
    """A tag whose end the pattern does not see, read like a match of it."""

    def __init__(self, found: re.Match, stop: int, attrs: str) -> None:
        self.found, self.stop, self.attrs = found, stop, attrs

    def __getitem__(self, group: str) -> str | None:
        return self.attrs if group == "attrs" else self.found[group]

    def start(self) -> int:
        return self.found.start()

    def end(self) -> int:
        return self.stop


Tag = re.Match | Followed


class _Ends:
    """Where tags end that a simple pattern does not see through.

    Outside of quotes a tag ends at the next ">" or with the page. A quoted value ends at
    its next quote, unless it holds a ">" and ends with "=": then it has run into the next
    tag's value and its quote was none. How it goes on from a mark does not depend on the tag
    that began before it, so each mark of a page is followed once, and broken tags of any
    number take linear time.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.known: dict[int, int] = {}

    def after(self, at: int) -> int:
        """The place behind the tag whose attributes begin at a place, or -1 where a quote is not closed."""
        page, seen, end = self.page, [], len(self.page)
        while mark := MARK.search(page, at):
            place = mark.start()
            if place in self.known:
                end = self.known[place]
                break
            seen.append(place)
            if page[place] == ">":
                end = place + 1
                break
            close = page.find(page[place], place + 1)
            if close < 0 or (page[close - 1] == "=" and page.find(">", place + 1, close) >= 0):
                end = -1
                break
            at = close + 1
        self.known |= dict.fromkeys(seen, end)
        return end


def tags(page: str) -> Iterator[Tag]:
    """Tags, comments and declarations in page order (groups name, end, attrs and cdata); send() moves on to a later place. A tag with a quote that is not closed ends at its first ">"."""
    at, ends = 0, _Ends(page)
    while m := TAG.search(page, at):
        if m["attrs"] is None and m["name"]:
            begin = m.end()
            stop = ends.after(begin)
            if stop < 0:
                stop = page.find(">", begin) + 1 or len(page)
            m = Followed(m, stop, page[begin : stop - (page[stop - 1] == ">")])
        at = (yield m) or m.end()


def _silent_end(page: str, at: int, name: str, never: set[str]) -> int:
    """Where an element without text ends: at its own closing tag, or at the next one where the nesting is broken.

    never: what is known of the rest of the page, so that no search is made twice in vain.
    """
    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)
    first = None if name in never else close.search(page, at)
    if first is None:
        never.add(name)
        if name not in RAW:
            return at
        found = TAG.search(page, at)
        return found.start() if found else len(page)
    if name in RAW or f"{name} nested" in never:
        return first.end()
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if depth == 0:
            return m.end()
    never.add(f"{name} nested")
    return first.end()


def blocks(page: str, paths: Paths | None = None) -> list[tuple[str, int, int]]:
    """(text, number of the tag path among ``paths``, characters inside links) of every text block, in page order; without ``paths`` all numbers are 0."""
    out: list[tuple[str, int, int]] = []
    stack = _Open(paths)
    parts: list[str] = []
    never: set[str] = set()
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, stack.node, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack.places.get("a"):
                linked += len(text.strip())

    def pop_to(names: Iterable[str]) -> None:
        place = stack.last(names)
        if place >= 0:
            flush()
            stack.cut(place)

    walk = tags(page)
    m = next(walk, None)
    while m is not None:
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        elif m["name"]:
            name, attrs = m["name"].lower(), m["attrs"]
            whole = attrs.endswith("/")
            if m["end"]:
                if stack.places.get(name):
                    if name in INLINE:
                        stack.close_one(name)
                    else:
                        flush()
                        stack.cut(stack.places[name][-1])
                elif name in ("p", "br"):
                    flush()
            elif name in SILENT:
                if not whole:
                    at = _silent_end(page, at, name, never)
            else:
                if name in CLOSES_P:
                    flush()
                    pop_to(("p",))
                    if name in SIBLING:
                        pop_to(SIBLING[name])
                if name == "br":
                    parts.append(" ")
                elif name not in VOID and not whole:
                    if name not in INLINE:
                        flush()
                    marks = " ".join(a or b or c for a, b, c in ATTR.findall(attrs)).lower() if attrs and paths else ""
                    stack.push(name, f"{name} {marks}" if marks else name)
                elif name not in INLINE:
                    flush()
        try:
            m = walk.send(at)
        except StopIteration:
            m = None
    add(page[at:])
    flush()
    return out


@functools.lru_cache(1 << 16)
def _slot(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % dim, 1.0 if h >> 16 & 1 else -1.0


def features(page_blocks: list[tuple[str, int, int]], paths: Paths) -> np.ndarray:
    """One input row for each block."""
    x = np.zeros((len(page_blocks), INPUT), np.float32)
    for row, (text, node, linked) in zip(x, page_blocks, strict=True):
        np.clip(paths.sums[node], -2, 2, out=row[:PATH_DIM])
        words = text.lower().split()
        for word in words:
            k, sign = _slot(word, WORD_DIM)
            row[PATH_DIM + k] += sign
        own = row[PATH_DIM : PATH_DIM + WORD_DIM]
        own /= max(1.0, len(words) ** 0.5)
        np.clip(own, -2, 2, out=own)  # one word repeated is no stronger than a mixed text
        e = row[PATH_DIM + WORD_DIM :]
        e[0] = np.log1p(len(words)) / 5
        e[1] = linked / len(text)
        e[2] = sum(text.count(c) for c in ".!?") / max(1, len(words))
        e[3] = float(text[-1] in ".!?…»”\"")
        e[4] = float("©" in text)
        e[5] = 1.0
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


class Lstm:
    """Bidirectional LSTM with a logistic output for each step, with its own gradients."""

    def __init__(self, rng: np.random.Generator, size: int = INPUT, hidden: int = HIDDEN) -> None:
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, (size + hidden) ** -0.5, (size + hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1
        self.p["v"] = rng.normal(0, (2 * hidden) ** -0.5, 2 * hidden).astype(np.float32)
        self.p["b"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, tape: list | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Outputs of one direction and the state after them; tape takes what gradients need."""
        steps, n, _ = x.shape
        k = self.hidden
        h, c = state or (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32))
        out = np.zeros((steps, n, k), np.float32)
        into = x @ self.p["w" + d][: x.shape[2]] + self.p["c" + d]
        back = self.p["w" + d][x.shape[2] :]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = into[t] + h @ back
            s = _sigmoid(z[:, : 3 * k])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            m = mask[t][:, None]
            c_new = (f * c + i * g) * m
            th = np.tanh(c_new)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, th, m))
            h, c = o * th * m, c_new
            out[t] = h
        return out, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.forward_parts(lambda k: (x, mask), 1)

    def forward_parts(self, part: Callable[[int], tuple[np.ndarray, np.ndarray]], parts: int) -> np.ndarray:
        """Probabilities of a sequence that comes in parts (inputs and mask of part k), one part held at a time."""
        k = self.hidden
        score: list[np.ndarray] = []
        state = None
        for at in range(parts):
            out, state = self._run("f", *part(at), state)
            score.append(out @ self.p["v"][:k])
        state = None
        for at in range(parts - 1, -1, -1):
            out, state = self._run("b", *part(at), state)
            score[at] = _sigmoid(score[at] + out @ self.p["v"][k:] + self.p["b"])
        return np.concatenate(score)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, favour: float = 1) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss; article text counts ``favour`` times."""
        tapes: dict[str, list] = {"f": [], "b": []}
        runs = {d: self._run(d, x, mask, None, tapes[d]) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        dz = (_sigmoid(both @ self.p["v"] + self.p["b"]) - y) * mask * (1 + (favour - 1) * y) / mask.sum()
        grads = {"v": np.einsum("tn,tnk->k", dz, both), "b": np.array([dz.sum()], np.float32)}
        size, k = x.shape[2], self.hidden
        for j, d in enumerate("fb"):
            own = dz[:, :, None] * self.p["v"][j * k : (j + 1) * k]
            w = self.p["w" + d]
            dzs, hs = np.zeros((*mask.shape, 4 * k), w.dtype), np.zeros((*mask.shape, k), w.dtype)
            back = w[size:].T.copy()
            dh, dc = np.zeros_like(own[0]), np.zeros_like(own[0])
            for t, h, c, i, f, o, g, th, m in reversed(tapes[d]):
                dh = (dh + own[t]) * m
                dct = (dc + dh * o * (1 - th * th)) * m
                dzt = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh * th * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                dzs[t], hs[t] = dzt, h
                dh, dc = dzt @ back, dct * f
            flat = dzs.reshape(-1, 4 * k)
            grads["w" + d] = np.concatenate([x.reshape(-1, size).T @ flat, hs.reshape(-1, k).T @ flat])
            grads["c" + d] = flat.sum(axis=0)
        return grads


#: Names that sites commonly give to the parts of a page.
ROLES = {
    "nav": "nav menu navbar navigation breadcrumbs topnav mainmenu toolbar tabs pagination".split(),
    "header": "header masthead banner branding topbar logo".split(),
    "side": "sidebar aside related widget rail archives popular recommended tagcloud blogroll links".split(),
    "notice": "notice cookie consent alert newsletter subscribe message popup modal paywall".split(),
    "advert": "ad ads advert advertisement sponsored promo banner-ad sponsor".split(),
    "comments": "comments comment comment-list commentlist replies discussion responses respond thread".split(),
    "footer": "footer site-footer colophon bottom legal copyright".split(),
    "social": "share social sharing follow".split(),
    "article": "content article post main-content entry entry-content story article-body main text body".split(),
    "wrap": "container wrapper row page inner outer layout grid section site center column box block".split(),
}
ELEMENTS = {"nav": "nav", "header": "header", "side": "aside", "comments": "section", "footer": "footer", "article": "article"}
LETTERS = "aeiounrstlmdkbgpvcéüñ"


class _Drawn:
    """A page drawn at random: pieces of markup, with a label for those that are a block (True for article text).

    Each page has its own habits: whether containers have their telling elements, their
    common names, invented names or none; how deep they are wrapped, whether columns are
    tables, what a paragraph is, how comments look. So no name decides alone, and what is
    around a block, its length, links and sentences have to.
    """

    def __init__(self, seed: int) -> None:
        rng = self.rng = random.Random(seed)
        self.pieces: list[tuple[str, bool | None]] = []
        self.told = self.pick(1.0, 1.0, 0.6, 0.0)  # share of telling elements
        self.named = self.pick(1.0, 0.7, 0.0, 0.0)  # share of common names
        self.tables = rng.random() < 0.15
        self.stops = rng.random() < 0.8
        sounds = ([int(rng.random() * len(LETTERS)) for _ in range(6)] for _ in range(rng.randrange(40, 600)))
        self.known = [LETTERS[a] + LETTERS[b] + LETTERS[c] * int(d % 3 > 0) + LETTERS[e] * int(d % 2) + LETTERS[f] * int(d % 5 == 0) for a, b, c, d, e, f in sounds]
        self.invented = ["".join(self.pick(*LETTERS[:17]) for _ in range(rng.randrange(2, 8))) for _ in range(12)]
        self.steep = self.pick(1, 2, 3)  # how often the page's common words are used

    def pick(self, *x):  # noqa: ANN002, ANN201
        return x[int(self.rng.random() * len(x))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int, stop: bool | None = None) -> str:
        picks = [self.known[int(len(self.known) * self.rng.random() ** self.steep)] for _ in range(self.rng.randrange(low, high))]
        stop = self.chance(0.85) if stop is None else stop
        if stop and self.stops:
            length = self.rng.randrange(6, 20)
            for k in range(length, len(picks), length):
                picks[k - 1] += "."
                picks[k] = picks[k].capitalize()
        joint = self.pick(*[" "] * 8, ", ", "".join(self.pick(*"|%*.-/#") for _ in range(self.rng.randrange(1, 4))) + " ")
        return joint.join(picks).capitalize() + "." * stop

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/x">{self.words(low, high, False)}</a>'

    def name(self, role: str) -> str:
        if self.chance(1.0 if role in ("advert", "notice") else self.named):  # texts like any other are told by name
            own = self.pick(*ROLES[role])
            if self.chance(0.2):
                own += self.pick("-1", "-wrap", " " + self.pick(*ROLES["wrap"]), "-" + self.pick(*ROLES[role]))
        elif self.chance(0.8):
            own = "-".join(self.pick(*self.invented) for _ in range(self.pick(1, 1, 2)))
        else:
            return ""
        return f' {self.pick("class", "class", "id")}="{own}"'

    def put(self, markup: str, label: bool | None = None) -> None:
        self.pieces.append((markup, label))

    def within(self, role: str, body: Callable[[], None], plain: str = "div") -> None:
        tag = ELEMENTS.get(role, plain) if self.chance(self.told) else self.pick("div", "div", plain)
        self.put(f"<{tag}{self.name(role)}>")
        body()
        self.put(f"</{tag}>")

    def links(self) -> None:
        n = self.rng.randrange(2, 12)
        if self.chance(0.75):
            self.put("<ul>")
            for _ in range(n):
                self.put(f"<li>{self.link()}{self.pick('', '', ' (3)')}</li>", False)
            self.put("</ul>")
        else:
            self.put(f"<p>{self.pick(' | ', ' ', ' &middot; ').join(self.link() for _ in range(n))}</p>", False)

    def junk(self, low: int, high: int, most: int, kinds: tuple[str, ...]) -> None:
        kind = self.pick(*kinds)
        texts = [self.words(low, high) for _ in range(self.rng.randrange(1, most + 1))]
        if kind:
            for t in texts:
                self.put(f"<{kind}>{t}</{kind}>", False)
        else:  # text without a block of its own runs together
            self.put(" ".join(texts), False)

    def header(self) -> None:
        self.within("header", lambda: self.junk(1, 6, 2, ("p", "h1", "div", "")))

    def nav(self) -> None:
        self.within("nav", self.links)

    def side(self) -> None:
        def body() -> None:
            for _ in range(self.rng.randrange(1, 4)):
                if self.chance(0.7):
                    h = self.pick("h2", "h3", "h4", "p", "div")
                    self.put(f"<{h}>{self.words(1, 4, False)}</{h}>", False)
                self.links() if self.chance(0.7) else self.junk(4, 30 if self.named == 1 else 10, 3, ("p", "p", "li", "div"))

        self.within("side", body)

    def notice(self) -> None:
        self.within("notice", lambda: self.junk(3, 40, 2, ("", "p", "p")))

    def advert(self) -> None:
        self.within("advert", lambda: self.junk(2, 40, 2, ("", "", "p")), "section")

    def social(self) -> None:
        self.within("social", self.links)

    def form(self) -> None:
        self.put(f"<form{self.name('notice') if self.chance(0.3) else ''}>")
        self.put(f"<label>{self.words(1, 4, False)}</label> <input name=q>", False)
        self.put(f"<button>{self.words(1, 3, False)}</button>", False)
        self.put("</form>")

    def comments(self) -> None:
        one, byline, reply = self.pick("li", "div", "article"), self.pick("" if self.named == 1 else "p", "p", "div", "h4"), self.chance(0.5)
        kind = self.pick("p", "p", "div", "")
        marks = self.name("comments")

        def body() -> None:
            if self.chance(0.7):
                h = self.pick("h2", "h3", "h4")
                self.put(f"<{h}>{self.pick('', '3 ')}{self.words(1, 4, False)}</{h}>", False)
            self.put("<ol>" if one == "li" else "<div>")
            for _ in range(self.rng.randrange(1, 9)):
                self.put(f"<{one}{marks}>")
                if byline:
                    self.put(f"<{byline}>{self.pick(self.link(1, 3), self.words(1, 3, False))} {self.words(1, 4, False)}{self.pick(':', '', ' 12:30')}</{byline}>", False)
                text = self.words(*self.pick((2, 15), (5, 60)))
                self.put(f"<{kind}>{text}</{kind}>" if kind else text, False)
                if reply and (kind or one):
                    self.put(f"<div>{self.link(1, 2)}</div>", False)
                self.put(f"</{one}>")
            self.put("</ol>" if one == "li" else "</div>")
            if self.chance(0.4):
                self.form()

        self.within("comments", body)

    def article(self) -> None:
        kind, size = self.pick("p", "p", "p", "p", "p", "div", "div", "br", "font", "run", "run"), self.pick((8, 40), (8, 90), (20, 90))
        if self.chance(0.8):
            h = self.pick("h1", "h1", "h2", "h3", "div")
            self.put(f"<{h}>{self.words(2, 14)}</{h}>", True)
        if kind == "run":  # all in one, told apart by line breaks only
            self.put("<hr>")
            self.put("<br><br>".join(self.words(*size) for _ in range(self.rng.randrange(1, 8))), True)
            self.put("<hr>")
            return
        for _ in range(self.rng.randrange(1, self.pick(4, 12, 25))):
            u = self.rng.random()
            text = self.words(*(size if self.chance(0.85) else (1, 8)))
            if self.chance(0.15):
                text += f" {self.pick(self.link(), '<b>' + self.words(1, 4, False) + '</b>')} {self.words(1, 12)}"
            if u < 0.7:
                if kind == "br":
                    text = "<br><br>".join([text, *(self.words(*size) for _ in range(self.rng.randrange(0, 4)))])
                inside = {"br": "<p>{}</p>", "font": "<p><font size=2>{}</font></p>"}.get(kind, f"<{kind}>{{}}</{kind}>")
                self.put(inside.format(text), True)
            elif u < 0.8:
                self.put(f"<p><b>{text}<br>", True)
            elif u < 0.86:
                h = self.pick("h2", "h2", "h3", "h4")
                self.put(f"<{h}>{self.words(1, 8, False)}</{h}>", True)
            elif u < 0.93:
                tag = self.pick("ul", "ol")
                self.put(f"<{tag}>")
                for _ in range(self.rng.randrange(1, 5)):
                    self.put(f"<li>{self.words(2, self.pick(8, 30))}</li>", True)
                self.put(f"</{tag}>")
            elif u < 0.96:
                self.put(f"<blockquote>{text}</blockquote>", True)
            elif u < 0.97:
                self.put(f"<pre>{text}</pre>", True)
            else:
                self.pick(self.advert, self.notice, self.advert, self.social)()

    def column(self, parts: list[Callable[[], None]]) -> None:
        self.put(f"<td{self.name('wrap') if self.chance(0.3) else ''}>" if self.tables else "")
        for part in parts:
            part()
        self.put("</td>" if self.tables else "")

    def page(self) -> tuple[str, list[bool]]:
        chosen = lambda p, *parts: [x for x in parts if self.chance(p)]
        article = (lambda: self.within("article", self.article, self.pick("div", "main", "section"))) if self.chance(0.8) else self.article
        depth = self.rng.randrange(0, 4) if self.chance(0.6) else 0
        for part in [*chosen(0.5, self.header), *chosen(0.85, self.nav), *chosen(0.25, self.notice, self.advert, self.advert, self.form)]:
            part()
        for _ in range(depth):
            self.put(f"<div{self.name('wrap')}>")
        if self.tables:
            self.put("<table><tr>")
        before = chosen(0.25, self.side, self.nav)
        if before:
            self.column(before)
        self.column([article, *chosen(0.25, self.social, self.notice, self.advert), *chosen(0.4, self.comments)])
        after = chosen(0.35, self.side, self.advert, self.form)
        if after:
            self.column(after)
        if self.tables:
            self.put("</tr></table>")
        self.put("</div>" * depth)
        if self.chance(0.1):
            self.comments()
        if self.chance(0.9):
            sign = self.pick("&copy; ", "&copy; ", "")
            self.within("footer", lambda: [self.links() if self.chance(0.15) else None, self.put(f"<p>{sign}{self.words(1, 25)}</p>" if self.chance(0.5) else f"{sign}{self.words(1, 25)}", False)])  # type: ignore[arg-type,return-value]
        text = "".join(t for t, _ in self.pieces)
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{text}</body></html>", [y for _, y in self.pieces if y is not None]


def layouts(rng: np.random.Generator, pages: int) -> Iterator[tuple[str, list[bool]]]:
    """Generated pages with a label for each of their blocks: True for article text."""
    for _ in range(pages):
        yield _Drawn(int(rng.integers(1 << 62))).page()


def _renamed(rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
    """A page's input as other words and, on some pages, other names would give it: what is alike stays alike."""
    x = x.copy()
    for at, size, share in ((TAG_DIM, NAME_DIM, 0.15), (PATH_DIM, WORD_DIM, 0.9)):
        if rng.random() < share:
            x[:, at : at + size] = x[:, at + rng.permutation(size)] * rng.choice((-1, 1), size)
    return x


def train(pages: int = 2_000, epochs: int = 7, batch: int = 24, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters of a network fitted on generated layouts."""
    rng = np.random.default_rng(seed)
    data, paths = [], Paths()
    for page, labels in layouts(rng, pages):
        found = blocks(page, paths)
        if len(found) == len(labels):
            data.append((features(found, paths), np.array(labels, np.float32)))
    lengths = np.array([len(y) for _, y in data])
    net = Lstm(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = np.argsort(lengths * rng.uniform(0.8, 1.25, len(data)))  # pages of about one length go together
        for at in rng.permutation(np.arange(0, len(order), batch)):
            x, mask, y = _padded([(_renamed(rng, data[k][0]), data[k][1]) for k in order[at : at + batch]])
            step += 1
            for k, g in net.gradients(x, mask, y, FAVOUR).items():
                g = np.clip(g, -1, 1)
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= 0.01 * 0.6**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net.p


def _padded(rows: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in rows)
    x = np.zeros((steps, len(rows), INPUT), np.float32)
    mask, y = np.zeros((steps, len(rows)), np.float32), np.zeros((steps, len(rows)), np.float32)
    for k, (a, b) in enumerate(rows):
        x[: len(a), k], mask[: len(a), k] = a, 1
        if b is not None:
            y[: len(a), k] = b
    return x, mask, y


def labeller(params: dict[str, np.ndarray]) -> Callable[[list[str | None]], list[list[tuple[str, float]]]]:
    """A function from pages to their blocks, each with its probability of being article text."""
    net = Lstm(np.random.default_rng(0))
    net.p = params
    paths = Paths()

    def label(pages: list[str | None]) -> list[list[tuple[str, float]]]:
        nonlocal paths
        if len(paths.sums) > 10_000:
            paths = Paths()
        found = [blocks(p or "", paths) for p in pages]
        out: list[list[tuple[str, float]]] = [[] for _ in pages]
        order = sorted((k for k, b in enumerate(found) if b), key=lambda k: len(found[k]))
        at = 0
        while at < len(order):
            end = at + 1  # pages of about the same number of blocks, at most 64 and about STEPS padded blocks at once
            while end < len(order) and end - at < 64 and (end - at + 1) * len(found[order[end]]) <= STEPS:
                end += 1
            own = order[at:end]

            @functools.lru_cache(1)
            def part(k: int, own: list[int] = own) -> tuple[np.ndarray, np.ndarray]:
                return _padded([(features(found[j][k * STEPS : (k + 1) * STEPS], paths), None) for j in own])[:2]

            p = net.forward_parts(part, -(-len(found[own[-1]]) // STEPS))
            for j, k in enumerate(own):
                out[k] = [(b[0], float(q)) for b, q in zip(found[k], p[:, j], strict=False)]
            at = end
        return out

    return label


def extract(pages: DataFrame, threshold: float = 0.5, batch: int = 64) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for every page."""
    session = pages.sparkSession
    if "html_blocks" not in worker_cache():
        worker_cache()["html_blocks"] = train()
    shared = session.sparkContext.broadcast(worker_cache()["html_blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeller(shared.value)
        for whole in batches:
            for at in range(0, len(whole), batch):
                ids, urls, sources = (c.to_pylist() for c in whole.slice(at, batch).columns)
                found = label(sources)
                kept = [[t for t, q in f if q >= threshold] for f in found]
                texts = ["\n\n".join(k) for k in kept]
                columns = [ids, urls, texts, [len(t) for t in texts], [len(f) for f in found], [len(k) for k in kept]]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
