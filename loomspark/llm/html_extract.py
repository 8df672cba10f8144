"""HTML extraction: a bidirectional LSTM labels the leaf blocks of a page, reading tag paths and hashed words."""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import nn
from loomspark.llm.common import small_batches
from loomspark.llm.token_counts import in_chunks

# --- blocks ----------------------------------------------------------------------------------------------------------

#: The elements that stand as blocks of their own, those without content, and those that show no text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes noscript xmp title".split())
UNSEEN = frozenset("script style iframe noembed noframes noscript xmp template svg math object video audio canvas head title datalist".split())
#: An opening tag ends an open element of these, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDS = frozenset("ul ol dl menu table select body html div article section main aside nav header footer form td th blockquote".split())
_PIECE = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=/?[a-zA-Z])", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|\Z)", re.I)
_TOKEN = re.compile(r"[^\W_]+")
_BLANKS = re.compile(r"[ \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Path:
    """An open element: its tag and class tokens, and the one around it.  Blocks share these, so depth costs nothing twice."""

    __slots__ = ("above", "depth", "marks", "_known")

    def __init__(self, marks: tuple[str, ...], above: Path | None):
        self.marks, self.above, self.depth = marks, above, (above.depth if above else 0) + 1
        self._known: frozenset[int] | None = None

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        """Marks from the innermost element outwards."""
        at: Path | None = self
        while at:
            yield at.marks
            at = at.above

    def known(self, n: int) -> frozenset[int]:
        """Buckets of the marks of this and all elements around it; an element that adds none shares the set of the one around it."""
        todo: list[Path] = []
        at: Path | None = self
        while at and at._known is None:
            todo.append(at)
            at = at.above
        found = at._known if at else frozenset()
        for x in reversed(todo):
            own = _buckets("", x.marks, n)
            found = found if own <= found else found | own
            x._known = found
        return found


@dataclass
class Block:
    text: str
    #: The innermost open element, None outside of all.
    path: Path | None
    #: Share of the characters that stand in links.
    linked: float


def _marks(tag: str, rest: str) -> tuple[str, ...]:
    found = [tag]
    if rest and "=" in rest or "hidden" in rest:
        for name, value in _ATTRIBUTE.findall(rest):
            if name.lower() == "hidden":
                found.append("@hidden")
            found += [t.lower() for t in _TOKEN.findall(html_lib.unescape(value.strip("\"'")))]
    return tuple(found)


class _Stack:
    """Open elements from the root, with the places of each tag, so that no question walks through all of them."""

    def __init__(self) -> None:
        self.paths: list[Path] = []
        self.seen: list[bool] = []
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, marks: tuple[str, ...], seen: bool) -> None:
        self.at[tag].append(len(self.paths))
        self.paths.append(Path(marks, self.paths[-1] if self.paths else None))
        self.seen.append(seen)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, i: int) -> bool:
        """Closes the element at i and all inside it; whether one of them was a block."""
        block = False
        for x in self.paths[i:]:
            block |= x.marks[0] in BLOCK
            self.at[x.marks[0]].pop()
        del self.paths[i:], self.seen[i:]
        return block

    @property
    def path(self) -> Path | None:
        return self.paths[-1] if self.paths else None

    @property
    def shows(self) -> bool:
        return not self.seen or self.seen[-1]


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order: references decoded, white space made one space, trimmed."""
    page = page or ""
    out: list[Block] = []
    stack = _Stack()
    held: list[str] = []
    linked = 0

    def flush(path: Path | None) -> None:
        nonlocal linked
        if held:
            text = _BLANKS.sub(" ", "".join(held)).strip(" ")
            if text:
                out.append(Block(text, path, min(1.0, linked / max(1, len(text)))))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and stack.shows:
            text = html_lib.unescape(text)
            held.append(text)
            if stack.at.get("a"):
                linked += len(text.strip())

    def close(i: int) -> None:
        path = stack.path
        if stack.cut(i):
            flush(path)

    at = 0
    while at < len(page):
        m = _PIECE.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m[2] is None:
            if m[0] == "<" and not (m := _LOOSE.match(page, m.start())):
                break  # a tag that the page's end cuts off is no text
            if m[0][1:2] in ("!", "?"):
                at = m.end()
                continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            i = stack.last((tag,))
            # An end tag of a block that holds no others doesn't reach out of the container it stands in.
            if i >= 0 and (tag in HOLDS or tag not in BLOCK or i > stack.last(HOLDS)):
                close(i)
            elif i < 0 and tag in BLOCK and (tag in HOLDS or stack.last(HOLDS) < 0):
                flush(stack.path)
            continue
        if tag in BLOCK:
            ends = {"p", *ENDS.get(tag, ())}
            while (i := stack.last(ends)) > stack.last(HOLDS - ends):
                close(i)
                if tag != "tr":
                    break
            flush(stack.path)
        if tag in VOID:
            held.append(" " if tag in ("br", "wbr", "img", "input") and tag != "wbr" else "")
            continue
        stack.push(tag, _marks(tag, m[3]), stack.shows and tag not in UNSEEN)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag == "textarea":
                add(page[at:stop])
            at = stop
    flush(stack.path)
    return out


# --- features --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parameters:
    path_buckets: int = 2048
    word_buckets: int = 2048
    path_size: int = 16
    word_size: int = 6
    hidden: int = 12
    pages: int = 1000
    passes: int = 18
    batch: int = 32
    rate: float = 0.015
    wordless: float = 0.5
    seed: int = 11
    #: Blocks, padding included, that go through the network together; a page with more goes through alone and whole.
    batch_blocks: int = 12_000


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode()) % n


@lru_cache(maxsize=50_000)
def _buckets(place: str, marks: tuple[str, ...], n: int) -> frozenset[int]:
    return frozenset(_bucket(f"{place}{'c' if k else 't'}:{t}", n) for k, t in enumerate(marks))


def _path_ids(path: Path | None, n: int) -> list[int]:
    """Buckets of all open elements' tags and classes, and again of the two innermost by their place."""
    if path is None:
        return []
    near = _buckets("0", path.marks, n) | (_buckets("1", path.above.marks, n) if path.above else frozenset())
    return sorted(path.known(n) | near)


NUMBERS = 6


def features(page: list[Block], p: Parameters) -> tuple[nn.Runs, nn.Runs, np.ndarray]:
    """Path buckets, word buckets and six numbers of each block."""
    paths = [_path_ids(b.path, p.path_buckets) for b in page]
    words = [[_bucket(w, p.word_buckets) for w in _TOKEN.findall(b.text.lower())] for b in page]
    runs = lambda x: nn.Runs(np.array([i for f in x for i in f], np.int64), np.array([len(f) for f in x], np.int64))
    n = len(page)
    numbers = np.array([[np.log1p(len(b.text)) / 5, b.linked, i / max(1, n - 1), float(b.text[-1] in ".!?…。"), (b.path.depth if b.path else 0) / 8, 1.0] for i, b in enumerate(page)], np.float32).reshape(n, NUMBERS)
    return runs(paths), runs(words), numbers


# --- network ---------------------------------------------------------------------------------------------------------


class Labeller:
    def __init__(self, p: Parameters):
        r = np.random.default_rng(p.seed)
        draw = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        n, d = p.hidden, p.path_size + p.word_size + NUMBERS
        self.p = p
        self.w: nn.Params = {
            "path": draw(p.path_buckets, p.path_size, scale=0.5), "word": draw(p.word_buckets, p.word_size, scale=0.1),
            "in_f": draw(d, 4 * n, scale=0.3), "in_b": draw(d, 4 * n, scale=0.3), "u_f": draw(n, 4 * n, scale=0.2), "u_b": draw(n, 4 * n, scale=0.2),
            "out": draw(2 * n, scale=0.4), "skip": draw(d, scale=0.2),
        }

    def inputs(self, page: tuple[nn.Runs, nn.Runs, np.ndarray]) -> np.ndarray:
        paths, words, numbers = page
        return np.concatenate([paths.means(self.w["path"]), words.means(self.w["word"]), numbers], axis=1)

    def forward(self, xs: list[np.ndarray], keep: bool = True) -> tuple[np.ndarray, tuple]:
        """Logits (T, B) of padded pages."""
        lengths = np.array([len(x) for x in xs])
        x = np.zeros((max(lengths), len(xs), xs[0].shape[1]), np.float32)
        for k, page in enumerate(xs):
            x[: len(page), k] = page
        mask = (np.arange(len(x))[:, None] < lengths).astype(np.float32)
        xb = nn.reverse(x, lengths)
        hf, cf = nn.lstm(x @ self.w["in_f"], mask, self.w["u_f"], keep)
        hb, cb = nn.lstm(xb @ self.w["in_b"], mask, self.w["u_b"], keep)
        h = np.concatenate([hf, nn.reverse(hb, lengths)], axis=2)
        return h @ self.w["out"] + x @ self.w["skip"], (x, xb, mask, lengths, h, cf, cb)

    def backward(self, dlogit: np.ndarray, cache: tuple) -> tuple[nn.Params, np.ndarray]:
        x, xb, mask, lengths, h, cf, cb = cache
        n = self.p.hidden
        g = {"out": np.einsum("tbh,tb->h", h, dlogit), "skip": np.einsum("tbd,tb->d", x, dlogit)}
        dh = dlogit[:, :, None] * self.w["out"]
        df, g["u_f"] = nn.lstm_back(dh[:, :, :n], cf)
        db, g["u_b"] = nn.lstm_back(nn.reverse(dh[:, :, n:], lengths), cb)
        g["in_f"], g["in_b"] = np.einsum("tbd,tbn->dn", x, df), np.einsum("tbd,tbn->dn", xb, db)
        dx = df @ self.w["in_f"].T + nn.reverse(db @ self.w["in_b"].T, lengths) + dlogit[:, :, None] * self.w["skip"]
        return g, dx * mask[:, :, None]

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; the state goes through all of a page in both directions, however long it is."""
        p, out = self.p, [np.zeros(len(b), bool) for b in pages]
        order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
        while order:
            # The longest of a batch sets its padding.
            n = min(p.batch, len(order))
            while n > 1 and n * len(pages[order[n - 1]]) > p.batch_blocks:
                n -= 1
            part, order = order[:n], order[n:]
            logits = self.forward([self.inputs(features(pages[k], p)) for k in part], keep=False)[0]
            for j, k in enumerate(part):
                out[k] = logits[: len(pages[k]), j] > 0
        return out


def fit(pages: list[tuple[list[Block], list[bool]]], p: Parameters) -> Labeller:
    net = Labeller(p)
    adam, rng = nn.Adam(net.w, p.rate), np.random.default_rng(p.seed)
    ready = [(features(b, p), np.array(y, np.float32)) for b, y in pages if b]
    ready.sort(key=lambda x: len(x[1]))
    batches = [ready[i : i + p.batch] for i in range(0, len(ready), p.batch)]
    for epoch in range(p.passes):
        adam.rate = p.rate * (1 if epoch < p.passes - 4 else 0.25)
        for k in rng.permutation(len(batches)):
            batch = batches[k]
            xs = [net.inputs(f) for f, _ in batch]
            # Some blocks are read without their words, as the words of a corpus are others than these.
            wordless = [rng.random(len(x)) < p.wordless for x in xs]
            for x, w in zip(xs, wordless, strict=True):
                x[w, p.path_size : p.path_size + p.word_size] = 0
            logit, cache = net.forward(xs)
            y = np.zeros_like(logit)
            for j, (_, label) in enumerate(batch):
                y[: len(label), j] = label
            mask = cache[2]
            grads, dx = net.backward((nn.sigmoid(logit) - y) * mask / mask.sum(), cache)
            grads["path"], grads["word"] = np.zeros_like(net.w["path"]), np.zeros_like(net.w["word"])
            for j, ((paths, words, _), label) in enumerate(batch):
                d = dx[: len(label), j].copy()
                d[wordless[j], p.path_size : p.path_size + p.word_size] = 0
                grads["path"] += paths.means_back(d[:, : p.path_size], net.w["path"])
                grads["word"] += words.means_back(d[:, p.path_size : p.path_size + p.word_size], net.w["word"])
            adam.step(grads)
    return net


# --- training pages --------------------------------------------------------------------------------------------------


@dataclass
class PageMaker:
    """Draws pages of varied layouts; a block's label is known from where it was put.

    Main text carries the mark \\x01 in front until the page is cut into blocks.
    """

    seed: int
    r: np.random.Generator = field(init=False)

    def __post_init__(self) -> None:
        self.r = np.random.default_rng(self.seed)

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self) -> str:
        parts = ("an", "er", "tion", "le", "que", "der", "sch", "ou", "is", "ca", "mo", "ti", "ver", "lo", "en", "st", "ria", "po", "und", "és")
        return "".join(parts[int(i)] for i in self.r.integers(len(parts), size=int(self.r.integers(1, 4))))

    def words(self, low: int, high: int, stop: bool | None = None) -> str:
        s = " ".join(self.word() for _ in range(int(self.r.integers(low, high))))
        return s.capitalize() + ("." if (self.chance(0.8) if stop is None else stop) else "")

    def sentences(self, high: int = 6) -> str:
        return " ".join(self.words(4, 16, True) for _ in range(int(self.r.integers(1, high))))

    def tag(self, name: str, body: str, *marks: str) -> str:
        named = [m for m in marks if m]
        how = self.pick("class", "class", "class", "id")
        if not named:
            return f"<{name}>{body}</{name}>"
        return f'<{name} {how}="{self.pick(*named)}">{body}</{name}>'

    def links(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high))
        return self.tag("ul", "".join(f'<li><a href="/{self.word()}">{self.words(1, 4, False)}</a></li>' for _ in range(n))) if self.chance(0.75) else " ".join(f'<a href="#">{self.words(1, 3, False)}</a>' for _ in range(n))

    # Blocks around the article; each gives HTML without marked text.

    def menu(self) -> str:
        return self.tag(self.pick("nav", "nav", "nav", "div", "ul", "header"), self.links(3, 9), self.pick("", "nav", "menu", "navbar", "main-nav", "navigation", "topnav", "breadcrumbs", "site-nav"))

    def top(self) -> str:
        body = self.pick(self.tag("h1", self.words(1, 4, False)), self.tag("p", self.words(2, 8)), self.tag("div", self.words(1, 5, False), "logo", "tagline", "site-title"), self.tag("a", self.words(1, 3, False)))
        return self.tag(self.pick("header", "header", "div"), body + (self.menu() if self.chance(0.4) else ""), "header", "site-header", "masthead", "banner", "top-bar")

    def advert(self) -> str:
        return self.tag(self.pick("div", "div", "aside", "section", "p"), self.pick(self.words(3, 14), self.tag("p", self.words(3, 20)), self.tag("a", self.words(2, 8))), "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "ad-slot", "adbox")

    def notice(self) -> str:
        body = self.pick(self.tag("p", self.words(4, 25)), self.words(4, 20)) + (self.tag("button", self.words(1, 3, False)) if self.chance(0.5) else "")
        return self.tag(self.pick("div", "div", "section", "aside", "dialog"), body, "cookie", "cookie-banner", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer", "notification", "warning", "message")

    def side(self) -> str:
        body = "".join(self.pick(lambda: self.tag("h3", self.words(1, 4, False)), lambda: self.links(2, 7), lambda: self.tag("p", self.sentences(4)), lambda: self.tag("div", self.words(3, 12)))() for _ in range(int(self.r.integers(1, 4))))
        return self.tag(self.pick("aside", "aside", "div", "section"), body, "sidebar", "related", "widget", "side", "recommended", "trending", "more", "see-also", "popular", "rail", "author-bio", "share", "social", "tags")

    def form(self) -> str:
        body = "".join(self.pick(self.tag("label", self.words(1, 4, False)), '<input type="text" value="x">', f"<select>{self.tag('option', self.word())}{self.tag('option', self.word())}</select>", self.tag("button", self.words(1, 3, False)), self.tag("p", self.words(3, 12)), f"<textarea>{self.words(0, 6)}</textarea>") for _ in range(int(self.r.integers(1, 5))))
        return self.tag("form", body, self.pick("", "search", "login", "signup", "contact", "subscribe-form"))

    def comments(self) -> str:
        one = lambda: self.tag(self.pick("div", "li", "article", "p", "section"), self.pick(self.tag("p", self.sentences(4)), self.words(3, 20), self.tag("b", self.words(1, 3, False)) + self.tag("p", self.sentences(5))), "comment", "reply", "comment-body", "user-comment", "response", "post-comment")
        body = (self.tag(self.pick("h2", "h3", "h4"), self.words(1, 3, False)) if self.chance(0.6) else "") + "".join(one() for _ in range(int(self.r.integers(1, 6)))) + (self.form() if self.chance(0.3) else "")
        return self.tag(self.pick("section", "div", "div", "ol", "ul", "aside"), body, "comments", "comment-list", "discussion", "responses", "reader-comments", "disqus", "replies")

    def foot(self) -> str:
        body = "".join(self.pick(lambda: f"&copy; {self.word()} &middot; {self.words(3, 20)}", lambda: self.tag("p", self.words(3, 16)), lambda: self.links(2, 6), lambda: self.tag("small", self.words(2, 8)))() for _ in range(int(self.r.integers(1, 4))))
        return self.tag(self.pick("footer", "footer", "footer", "div"), body, "footer", "site-footer", "bottom", "copyright", "legal", "colophon")

    # The article; its text carries the mark.

    def body(self) -> str:
        """Mostly sentences, but an article may hold any text."""
        if self.chance(0.75):
            return self.sentences(int(self.pick(3, 7, 7, 25)))
        w = self.word()
        return self.pick(
            lambda: " ".join([w] * int(self.r.integers(2, 60))), lambda: self.words(4, 40).replace(" ", " | "), lambda: self.words(4, 60).replace(" ", self.pick("*** ", "$$$ ", "!! ")),
            lambda: self.words(3, 30).upper(), lambda: self.words(1, 4), lambda: self.words(20, 120, False),
        )()

    def main_block(self) -> str:
        mark = "\x01"
        inline = lambda s: s.replace(" ", f" {self.pick('<b>', '<i>', '<em>', '<span>')}", 1) if self.chance(0.15) else s.replace(" ", "<br>", 1) if self.chance(0.1) else s
        kind = int(self.r.integers(12))
        if kind < 7:
            open_p = self.chance(0.15)
            return f"<p>{mark}{inline(self.body())}" + ("" if open_p else "</p>")
        if kind == 7:
            return self.tag(self.pick("h2", "h3", "h4"), mark + self.words(1, 7, False))
        if kind == 8:
            return self.tag(self.pick("ul", "ol"), "".join(self.tag("li", mark + self.pick(self.words(1, 12), f'<a href="#">{self.words(1, 5)}</a>')) for _ in range(int(self.r.integers(1, 6)))))
        if kind == 9:
            return self.tag("blockquote", self.pick(mark + self.sentences(3), self.tag("p", mark + self.sentences(3))))
        if kind == 10:
            return self.tag("table", "".join("<tr>" + "".join(self.tag(self.pick("td", "td", "th"), mark + self.words(1, 4, False)) for _ in range(2)) + "</tr>" for _ in range(int(self.r.integers(1, 4)))))
        return self.pick(self.tag("pre", mark + self.words(3, 12)), self.tag("figure", self.tag("figcaption", mark + self.words(3, 12))), self.tag("div", mark + self.body()), f"<p>{mark}{self.words(1, 3)}</p>")

    def article(self) -> str:
        inner = "".join(self.main_block() for _ in range(int(self.r.integers(1, 14))))
        if self.chance(0.35):
            cut = self.pick(self.advert, self.side, self.notice, self.form)()
            inner = inner + cut if self.chance(0.5) else cut + inner
            inner += "".join(self.main_block() for _ in range(int(self.r.integers(0, 4))))
        head = self.tag("h1", "\x01" + self.words(1, 14, False)) if self.chance(0.85) else ""
        if self.chance(0.15):
            head = self.tag("header", head)
        if self.chance(0.2):
            inner = self.tag(self.pick("div", "section"), inner, "content", "body", "text", "entry", "post-body")
        if self.chance(0.2):
            inner += self.comments()
        name, marks = self.pick(("article", ("",)), ("article", ("",)), ("article", ("",)), ("article", ("post", "entry", "story", "article")), ("main", ("", "content")), ("div", ("content", "article", "post", "entry-content", "main", "article-body", "story", "text")), ("section", ("content", "article", "main")))
        return self.tag(name, head + inner, *marks)

    def page(self) -> tuple[list[Block], list[bool]]:
        some = lambda p, *makers: "".join(m() for m in makers if self.chance(p))
        before = some(0.45, self.notice, self.top, self.menu, self.advert, self.form, self.side)
        after = some(0.45, self.comments, self.side, self.advert, self.notice, self.menu, self.foot, self.form)
        body = self.article() if self.chance(0.97) else ""
        if self.chance(0.2) and body:
            body = self.tag(self.pick("div", "main"), body + (self.side() if self.chance(0.5) else ""), self.pick("", "container", "wrapper", "page", "layout", "row"))
        html = f"<html><head><title>{self.words(2, 8)}</title></head><body>{before}{body}{after}</body></html>"
        if self.chance(0.1):
            html = html[: int(len(html) * self.r.uniform(0.5, 1))]
        found = blocks(html)
        labels = ["\x01" in b.text for b in found]
        return [Block(t, b.path, b.linked) for b in found if (t := b.text.replace("\x01", "").strip(" "))], [y for b, y in zip(found, labels, strict=True) if b.text.replace("\x01", "").strip(" ")]


@lru_cache(maxsize=2)
def trained(p: Parameters = Parameters()) -> Labeller:
    """The labeller, fitted on drawn pages; the same for the same parameters."""
    maker = PageMaker(p.seed)
    return fit([maker.page() for _ in range(p.pages)], p)


# --- operator --------------------------------------------------------------------------------------------------------


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    found = [blocks(x) for x in pages]
    return ["\n".join(b.text for b, keep in zip(f, kept, strict=True) if keep) for f, kept in zip(found, labeller.labels(found), strict=True)]


def extracted(page: Column, labeller: Labeller, spark) -> Column:
    shared = spark.sparkContext.broadcast(labeller)

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            # Pages are taken up by their length, so that many long ones don't meet.
            yield pd.Series([t for c in in_chunks(s, 4_000_000) for t in main_texts(c, shared.value)], dtype="object")

    return extract(page)


def html_extract(pages: DataFrame, html: str = "html", p: Parameters = Parameters()) -> DataFrame:
    """pages with text, the main blocks joined by newlines ("" if there is none), and n_chars, its code points.

    Null and empty pages have no text, and an empty table gives an empty table.  Pages are read one by one and whole, every
    block and every word of it, so repeated rows stay and other columns don't matter; time and memory grow with a page's
    length, not with how deep its elements are nested.  Columns named text or n_chars are replaced.
    """
    small_batches(pages.sparkSession)
    done = pages.withColumn("text", extracted(F.coalesce(pages[html], F.lit("")), trained(p), pages.sparkSession))
    return done.withColumn("n_chars", F.length("text").cast("long"))
