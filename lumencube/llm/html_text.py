"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Every block has a vector: hashed vectors of the tags and of the class and
id words on its path, the mean of the hashed vectors of its words, and a few sizes. A bidirectional LSTM in numpy reads
the sequence in both directions, so every block is labelled in the light of the whole page; the text of the blocks
labelled as article is joined.

There are no labelled pages, so the labeller is fitted on pages composed here: blocks of a bounded sample of the table's
pages, set into layouts drawn from a list of usual places for articles and for what surrounds them. The fit takes
some seconds on the driver and does not grow with the table; its weights are broadcast.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, share, text_batches

#: Pages whose blocks the composed pages are filled with, blocks of each and characters of a block at most (others are no filling), and the number of composed pages.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_CHARS, COMPOSED = 256, 32, 2000, 3000
PATH_DIM, LEAF_DIM, WORD_DIM, SIZES, HIDDEN = 40, 32, 16, 4, 20
DIM = PATH_DIM + LEAF_DIM + WORD_DIM + SIZES
#: Places that a worker remembers at most.
PLACES = 1 << 13
#: What is left of a path's vector with each level, of its slow and its fast part.
FAR, NEAR = 0.97, 0.6
#: Blocks of a padded batch of pages that are labelled together, and of those whose input to the gates is held at a time.
CELLS, STRETCH = 1 << 17, 1 << 13

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td textarea tfoot th thead tr ul button label br".split()
)
#: Raw text up to its end tag, never read as blocks.
RAW = frozenset("script style title".split())
#: Text of these stands apart from the text around it, but does not end a paragraph.
APART = frozenset("noscript template iframe object".split())

# A quote counts only where a value starts; one that never closes is part of the value.
_ATTRS = r"(?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?)*+"
_NAME = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)")
_TAIL, _LOOSE = re.compile(rf"(?P<attrs>{_ATTRS})>"), re.compile(r"(?P<attrs>[^>]*+)>")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in (*RAW, *APART)}
_ALONE = re.compile(r"(?:^|[\s\"'])/\Z")
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names(attrs: str) -> tuple[str, ...]:
    """Words of the class, id, role and itemprop attributes."""
    if "=" not in attrs:
        return ()
    found = "-".join("".join(m) for m in _NAMED.findall(attrs))
    return tuple(x.lower() for x in _PART.findall(found))


@lru_cache(maxsize=1 << 14)
def _hashed(word: str, dim: int) -> np.ndarray:
    seed = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return (np.random.default_rng(seed).integers(0, 2, dim) * 2.0 - 1.0).astype(np.float32)


class Place:
    """Where a block stands: an element within another place. Its vector is carried along, so that depth costs nothing.

    The vector holds the sum of the hashed vectors of all tags and names on the path, which fades slowly with the distance,
    and a second one in which what stands nearer to the leaf counts more.
    """

    __slots__ = ("tag", "names", "up", "total", "leaf", "inner", "vector")

    def __init__(self, tag: str = "", names: tuple[str, ...] = (), up: Place | None = None):
        self.tag, self.names, self.up, self.inner = tag, names, up, {}
        self.total = np.zeros(PATH_DIM, np.float32) if up is None else up.total * np.float32(FAR)
        self.leaf = np.zeros(LEAF_DIM, np.float32) if up is None else up.leaf
        for x in (f"<{tag}>", *names) if tag else ():
            self.total = self.total + _hashed(x, PATH_DIM)
            self.leaf = self.leaf * np.float32(NEAR) + _hashed("leaf " + x, LEAF_DIM)
        self.vector = np.concatenate([self.total / 2.0, self.leaf])

    def child(self, tag: str, names: tuple[str, ...] = ()) -> Place:
        found = self.inner.get((tag, names))
        if found is None:
            found = Place(tag, names, self)
            Place.made += 1
            if len(self.inner) < 64:  # places come again and again, on one page and on others
                self.inner[tag, names] = found
        return found

    @classmethod
    def root(cls) -> Place:
        """The page itself; places that pages have in common are made once, until there are too many of them."""
        if cls.top is None or cls.made > PLACES:
            cls.top, cls.made = cls(), 0
        return cls.top

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at.up is not None:
            out.append((f"<{at.tag}>", *at.names))
            at = at.up
        return tuple(x for part in reversed(out) for x in part)


Place.top, Place.made = None, 0


def blocks(page: str | None) -> list[tuple[Place, str, int]]:
    """(place, text, characters in links) of the page's leaf blocks, in page order; the text has single spaces.

    The page is read once from left to right. A tag ends at the first > that no quoted value holds; where that finds no
    end, it ends at the first >, and so do all tags after it.
    """
    out: list[tuple[Place, str, int]] = []
    root = Place.root()
    stack: list[tuple[str, Place]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = at = 0
    page = page or ""
    last, careful = page.rfind(">"), True
    ends: dict[str, re.Match | None] = {}

    def end(name: str, start: int) -> re.Match | None:
        """The next end tag; pages are searched once, however many elements are left open."""
        if name not in ends or (ends[name] and ends[name].start() < start):
            ends[name] = _END[name].search(page, start)
        return ends[name]

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((stack[-1][1] if stack else root, text, links))
        parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        parts.append(text)
        if opened["a"]:
            links += len(text)

    def push(tag: str, names: tuple[str, ...] = ()) -> None:
        stack.append((tag, (stack[-1][1] if stack else root).child(tag, names)))
        opened[tag] += 1

    def close(i: int) -> None:
        opened.subtract(tag for tag, _ in stack[i:])
        del stack[i:]

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            add(page[at:start])
            at = page.find("-->", start + 4) + 3
            if at < 3:
                at = len(page)
            continue
        if start > last:  # nothing ends any more
            break
        m = _NAME.match(page, start)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                add(page[at:start])
                at = page.index(">", start) + 1
            else:
                add(page[at : start + 1])
                at = start + 1
            continue
        tail = _TAIL.match(page, m.end()) if careful else None
        if tail is None:
            careful = False
            tail = _LOOSE.match(page, m.end())
        if start > at:
            add(page[at:start])
        at = tail.end()
        tag, shut, attrs = m["tag"].lower(), bool(m["close"]), tail["attrs"]
        if tag in RAW and not shut:
            if not _ALONE.search(attrs):
                if found := end(tag, at):
                    at = found.end()
                elif tag == "title":  # left open: what follows is the page
                    push(tag)
                else:
                    at = len(page)
            continue
        if tag in BLOCKS:
            if tag == "br":
                add(" ")
                continue
            flush()
        elif tag in APART:
            flush()
            if not shut and not end(tag, at):  # left open: what follows is not inside
                continue
        if shut:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            continue
        if tag in BLOCKS and (opened["p"] or opened["li"]):  # an open paragraph ends here, and so does a list item before the next
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag == "li":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag not in VOID and not attrs.endswith("/"):
            push(tag, _names(attrs))
    if at < len(page):
        add(page[at:])
    flush()
    return out


_WORDS = 4096
_TABLE = np.random.default_rng(7).standard_normal((_WORDS, WORD_DIM)).astype(np.float32)


@lru_cache(maxsize=1 << 16)
def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % _WORDS


def vectors(page: list[tuple[Place, str, int]]) -> np.ndarray:
    out = np.empty((len(page), DIM), np.float32)
    words = [t.split(" ") for _, t, _ in page]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((_bucket(w) for ws in words for w in ws), np.int64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    sums = np.zeros((len(page), WORD_DIM))
    for at in range(0, len(page), 512):  # a few blocks at a time: pages may be very long
        end = min(at + 512, len(page))
        last = starts[end] if end < len(page) else len(ids)
        for lo in range(starts[at], last, 1 << 16):
            hi = min(lo + (1 << 16), last)
            owner = np.searchsorted(starts, np.arange(lo, hi), side="right") - 1
            np.add.at(sums, owner, _TABLE[ids[lo:hi]]) if hi - lo < 64 else _add_runs(sums, owner, _TABLE[ids[lo:hi]])
    out[:, PATH_DIM + LEAF_DIM : -SIZES] = sums / np.sqrt(counts)[:, None] / 3
    for i, (place, text, links) in enumerate(page):
        out[i, : PATH_DIM + LEAF_DIM] = place.vector
        out[i, -SIZES:] = (np.log1p(counts[i]) / 4, min(1.0, links / len(text)), text[-1] in ".!?", text[:1].isupper())
    return out


def _add_runs(sums: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sums[owner[first]] += np.add.reduceat(rows, first, axis=0)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over sequences of block vectors with one logit per block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.standard_normal((DIM, 4 * HIDDEN)) / np.sqrt(DIM)
            self.p[f"h{d}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.p["out"] = rng.standard_normal(2 * HIDDEN) / np.sqrt(HIDDEN)
        self.p["bias"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        steps, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        stretch = max(1, STRETCH // n)
        out, tape = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            if t % stretch == 0:  # not for all steps at once: a page may be very long
                drive = x[t : t + stretch] @ self.p[f"x{d}"] + self.p[f"c{d}"]
            z = drive[t % stretch] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                tape.append((h, c, i, f, o, g, th, m))
            c, h = m * new + (1 - m) * c, m * (o * th) + (1 - m) * h
            out[t] = h
        return out, tape

    def _back(self, d: str, x: np.ndarray, tape, grad_out: np.ndarray, grads: dict):
        steps = x.shape[0]
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros(x.shape[1:2] + (HIDDEN,), np.float32)
        w = self.p[f"h{d}"]
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, th, m = tape[t]
            dh = dh + grad_out[t]
            dnew = (dh * m * o) * (1 - th * th) + dc * m
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dh * m * th * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grads[f"h{d}"] += h.T @ dz
            dh, dc = dz @ w.T + dh * (1 - m), dnew * f + dc * (1 - m)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"x{d}"] += x.reshape(-1, DIM).T @ flat
        grads[f"c{d}"] += flat.sum(0)

    @staticmethod
    def _pad(pages: list[np.ndarray]):
        n, steps = len(pages), max(len(p) for p in pages)
        x, back = np.zeros((steps, n, DIM), np.float32), np.zeros((steps, n, DIM), np.float32)
        mask = np.zeros((steps, n), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], back[: len(p), k], mask[: len(p), k] = p, p[::-1], 1
        return x, back, mask

    @staticmethod
    def _flip(a: np.ndarray, lengths: list[int]) -> np.ndarray:
        out = np.zeros_like(a)
        for k, n in enumerate(lengths):
            out[:n, k] = a[:n, k][::-1]
        return out

    def logits(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Logits of the blocks of non-empty pages; best called with pages of like length."""
        x, back, mask = self._pad(pages)
        lengths = [len(p) for p in pages]
        fore, rear = self._run("f", x, mask, False)[0], self._flip(self._run("b", back, mask, False)[0], lengths)
        z = fore @ self.p["out"][:HIDDEN] + rear @ self.p["out"][HIDDEN:] + self.p["bias"]
        return [z[:n, k] for k, n in enumerate(lengths)]

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5, averaged: int = 4) -> None:
        """Weights are the mean over all steps of the last `averaged` epochs, which depends less on seed and sample than any one step."""
        rng = np.random.default_rng(seed)
        total, steps = {k: np.zeros(v.shape) for k, v in self.p.items()}, 0
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                part = [pages[i] for i in chosen]
                lengths = [len(p) for p in part]
                x, back, mask = self._pad(part)
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(chosen):
                    y[: lengths[k], k] = labels[i]
                fore, tape_f = self._run("f", x, mask, True)
                behind, tape_b = self._run("b", back, mask, True)
                rear = self._flip(behind, lengths)
                z = fore @ self.p["out"][:HIDDEN] + rear @ self.p["out"][HIDDEN:] + self.p["bias"]
                dz = (_sigmoid(z) - y) * mask / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["out"] = np.concatenate([np.tensordot(dz, fore, 2), np.tensordot(dz, rear, 2)])
                grads["bias"][0] = dz.sum()
                self._back("f", x, tape_f, dz[..., None] * self.p["out"][:HIDDEN], grads)
                self._back("b", back, tape_b, self._flip(dz[..., None] * self.p["out"][HIDDEN:], lengths), grads)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                lr = rate * (0.3 if epoch >= epochs - 2 else 1.0)
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if epoch >= epochs - averaged:
                    steps += 1
                    for k, v in self.p.items():
                        total[k] += v
        if steps:
            self.p = {k: (v / steps).astype(np.float32) for k, v in total.items()}


# Usual places of an article and of what surrounds it, as open tags; the text goes into the last one.
ARTICLE = (
    "<article>", "<main>", "<main><article>", "<div class=content>", "<div id=content>", "<div id=main>", "<div class=article>", "<div class='article-body'>", "<div class='post-content'>", "<div class='entry-content'>", "<section class=story>", "<div class='main-content'>",
    "<article class=post>", "<div class=post>", "<div id=article>", "<div class=text>", "<section itemprop=articleBody>", "<div role=main>", "<div class='story-body'>", "<main id=content><article class=entry>", "<section>", "<div class=page><article>", "<div class=wrapper><article>", "<div id=wrapper><div class=content>",
    "<noscript><article>", "<template><article>", "<object><article>",
)
BEFORE = (
    "<nav><ul><li><a>", "<nav><a>", "<header><div>", "<header><h1>", "<header><nav><ul><li><a>", "<header><p>", "<div class=header><p>", "<div id=header><h1>", "<div class=menu><ul><li><a>", "<ul class=menu><li><a>", "<div id=nav><ul><li><a>", "<div class=navbar><a>", "<div class=breadcrumbs><a>", "<ul class=breadcrumb><li><a>",
    "<div class=ad>", "<div class=ads><p>", "<div class=advert>", "<div class=banner>", "<div class=promo><p>", "<div class=sponsored><a>", "<div id=ad><p>", "<div class=advertisement><p>", "<div class=notice>", "<div class='cookie-notice'><p>", "<div id=cookie><p>", "<div class=cookies>", "<div class=alert><p>", "<div class=consent><p>", "<div role=alert>", "<div role=navigation><a>", "<div role=banner>",
    "<form><label>", "<form class=search><label>", "<form><button>", "<div class=login><form><p>", "<aside><p>", "<aside><ul><li><a>", "<aside><h2>", "<div class=sidebar><p>", "<div id=sidebar><ul><li><a>", "<div class=topbar>", "<div class=popup><p>", "<div class=modal><p>", "<div class=skip><a>", "<noindex><div class=ad>", "<noscript><p>",
)
AFTER = (
    "<footer>", "<footer><p>", "<footer><ul><li><a>", "<div class=footer><p>", "<div id=footer>", "<div class=copyright>", "<footer><div class=legal><p>", "<section class=comments><p>", "<div class=comments><div class=comment><p>", "<div id=comments><ul><li>", "<ol class=commentlist><li><p>", "<div class=comment>", "<section id=comments><article class=comment><p>", "<div class='reader-comments'><p>", "<div class=responses><p>", "<div class=discussion><p>",
    "<div class=related><ul><li><a>", "<div class=share><a>", "<ul class=social><li><a>", "<div class=recommended><a>", "<div class=newsletter><form><p>", "<div class=subscribe><p>", "<div class=pagination><a>", "<div class=tags><a>", "<div class=widget><p>", "<div class=disclaimer><p>", "<div role=contentinfo><p>", "<div role=complementary><p>", "<section class=related><h3>", "<div class='footer-links'><a>", "<form class=comment><label>",
)
INSIDE = (
    "<aside>", "<aside><p>", "<div class=ad>", "<div class=ads><p>", "<div class=advert><p>", "<div class=promo>", "<form><p>", "<form><label>", "<div class=comments><p>", "<section class=comments><p>", "<div class=comment><p>", "<nav><ul><li><a>", "<div class=sidebar><p>", "<div class=share><a>", "<div class=related><a>", "<footer><p>", "<div class=newsletter><p>", "<div class=notice><p>", "<div class=sponsored><p>", "<noscript>", "<noscript><p>", "<iframe>", "<iframe><p>", "<template>", "<template><p>",
)
TEXT = ("<p>", "<p>", "<p>", "<p>", "<p><b>", "<h1>", "<h2>", "<h3>", "<ul><li>", "<ol><li>", "<blockquote><p>", "<blockquote>", "<pre>", "<div>", "<div><p>", "<table><tr><td>", "<section><p>", "<section><h2>", "<figure><figcaption>", "<dl><dd>", "<p><a>", "<p><em>", "<object><p>", "")
NEUTRAL = ("container", "wrap", "row", "col", "inner", "page", "site", "box", "clearfix", "grid", "left", "right", "first", "block", "section", "group")
#: What stands around articles in many languages and layouts, word for word.
SIGNS = (
    "Home", "About", "Contact", "Log in", "Sign up", "Search", "Menu", "Share", "Next", "Previous", "Read more", "Privacy policy", "Terms of use", "Copyright 2024", "© 2023 All rights reserved.", "All rights reserved", "Subscribe to our newsletter", "We use cookies to improve this site.", "Accept", "Advertisement", "Sponsored", "Related articles", "Leave a comment", "Reply", "Skip to content", "Follow us", "Sitemap", "Imprint", "Accueil", "Startseite", "Inicio", "Impressum", "Datenschutz", "Mentions légales",
)

_OPEN = re.compile(r"<([a-z0-9]+)([^>]*)>")


def within(place: Place, opened: str) -> Place:
    for tag, attrs in _OPEN.findall(opened):
        place = place.child(tag, _names(attrs))
    return place


def compose(texts: list[str], n: int = COMPOSED, seed: int = 11, lists: tuple = (ARTICLE, BEFORE, AFTER, INSIDE)) -> tuple[list[list], list[np.ndarray]]:
    """n pages as block sequences, with labels: 1 for blocks of the article. texts: what to fill them with.

    Half of the pages hide what their elements are called: the names are left out or are made up, as by tools that
    generate style sheets, and articles stand in plain divisions, in cells of a table or in the body itself.
    """
    article, before, after, inside = lists
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    chance = lambda p: rng.random() < p
    texts = [t for t in texts if t.count(" ") >= 7] or [t for t in texts if t.strip()] or ["Text."]  # shorter ones may be menus

    def short() -> str:
        words = pick(texts).split()
        at, k = int(rng.integers(len(words))), 1 + int(rng.integers(4))
        return " ".join(words[at : at + k])

    def telling() -> str:
        """What an article's block may say: a block of the table's, several of them in one, a sentence with other words, or a few words over and over."""
        if chance(0.06):
            return " ".join(pick(texts) for _ in range(2 + int(rng.integers(10))))
        if chance(0.2):  # the words of usual signs are no signs in a sentence
            signs, words = " ".join(SIGNS).lower().split(), pick(texts).split()
            return " ".join(pick(signs if chance(0.5) else words) for _ in range(4 + int(rng.integers(14)))).capitalize() + "."
        if chance(0.1):
            words = pick(texts).split()
            at, k = int(rng.integers(len(words))), 1 + int(rng.integers(4)) ** 2
            return " ".join(words[at : at + k] * (4 + int(rng.integers(12)) ** 2 * 4 // k))
        return pick(texts)

    def made_up() -> str:
        return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 3 + int(rng.integers(5))))

    def veiled(opened: str) -> str:
        """The same elements with other names or none; elements whose own name says what they are become divisions."""
        plain = re.sub("<(?:nav|header|footer|aside|article|main|section|noindex)", "<div", re.sub(r"<(\w+)[^>]*>", r"<\1>", opened))
        return re.sub("<div>", lambda _: f"<div class={made_up()}>" if chance(0.6) else "<div>", plain)

    def some(opened: str, base: Place, page: list, labels: list, hidden: bool) -> None:
        """Blocks that are no part of the article. Where nothing else tells, they are short, links, or said in usual words."""
        link, row = "<a>" in opened, "<li>" in opened or "<a>" in opened
        place = within(base, veiled(opened) if hidden else opened)
        for _ in range(1 + int(rng.integers(6 if row else 3))):
            if chance(0.35) or hidden and not link:
                text = pick(SIGNS)
            elif row or chance(0.3):
                text = short()
            else:
                text = " ".join(pick(texts).split()[: 3 + int(rng.integers(60))])
            page.append((place, text, len(text) if link else 0))
            labels.append(0)

    pages, all_labels = [], []
    for _ in range(n):
        page, labels = [], []
        hidden, table, bare = chance(0.55), chance(0.12), chance(0.12)
        base = root = Place().child("html").child("body")
        for _ in range(int(rng.integers(3)) if chance(0.4) and not bare else 0):
            base = base.child("div", (made_up() if hidden else pick(NEUTRAL),))
        cell = "<table><tr><td>" if chance(0.5) else "<table><tbody><tr><td>"
        around = (lambda: within(base, cell if chance(0.7) else "<center>")) if table else (lambda: base)
        for _ in range(int(rng.integers(5))):
            some(pick(before), around(), page, labels, hidden)
        if bare:
            place = root
        elif table:
            place = within(base, cell + ("<p>" if chance(0.2) else ""))
        elif hidden:
            place = within(base, veiled("<div><div>" if chance(0.4) else "<div>"))
        else:
            place = within(base, ("<noscript>" if chance(0.06) else "") + ("<article>" if chance(0.35) else pick(article)))
        blocks_in = 1 + int(rng.integers(14)) if chance(0.9) else 30 + int(rng.integers(60))
        for k in range(blocks_in):
            if chance(0.3 if k and k == blocks_in - 1 else 0.15):  # an article may end with a few lines behind an advert
                some(pick(inside), place, page, labels, hidden)
            opened = "<h1>" if k == 0 and chance(0.7) else "<p>" if bare and chance(0.8) else pick(TEXT)
            at = place.child("div", (made_up() if hidden else pick(NEUTRAL),)) if chance(0.05) else place
            text = telling() if chance(0.8) else short()
            if chance(0.2):
                text = " ".join(pick(texts).split()[: 5 + int(rng.integers(12))]).rstrip(".,;") + "."
            if hidden and not opened.startswith("<h") and len(text) < 30:
                text = pick(texts)
            if opened == "<h1>":
                text = text[:60]
            linked = "<a>" in opened and chance(0.5) and not hidden
            page.append((within(at, opened), " ".join(text.split()) or "Text.", len(text) if linked else 0))
            labels.append(1)
        if chance(0.12):
            some(pick(inside), place, page, labels, hidden)
        for _ in range(int(rng.integers(4))):
            some(pick(after) if chance(0.8) else pick(before), around(), page, labels, hidden)
        pages.append(page)
        all_labels.append(np.array(labels, np.float32))
    return pages, all_labels


def filling(pages: DataFrame, id_col: str, html_col: str, sample: int) -> list[str]:
    """Texts of blocks of at most `sample` pages (by the hash of id and html): SAMPLE_BLOCKS of each, picked by a hash, none over SAMPLE_CHARS."""
    key = F.xxhash64(id_col, html_col).alias("key")
    known = pages.where(F.col(html_col).isNotNull())
    keys = F.broadcast(known.select(key).distinct().orderBy("key").limit(sample))  # at most `sample` hashes
    chosen = known.select(key, F.col(html_col).alias("t")).join(keys, "key").dropDuplicates(["key"])

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                texts = sorted({x for _, x, _ in blocks(t.as_py()) if len(x) <= SAMPLE_CHARS}, key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass")), x))
                rows += [(k, x) for x in texts[:SAMPLE_BLOCKS]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["key", "t"])

    return [r["t"] for r in sorted(chosen.mapInArrow(lean(run), "key long, t string").collect(), key=lambda r: (r["key"], r["t"]))]


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Labeller:
    """A labeller fitted on composed pages that are filled with blocks of the table's own."""
    composed, labels = compose(filling(pages, id_col, html_col, sample))
    model = Labeller()
    model.fit([vectors(p) for p in composed], labels)
    return model


def _batches(lengths: list[int], batch: int):
    """(lo, hi) of ascending lengths: at most `batch` pages and CELLS steps times pages, a longer page alone."""
    lo = 0
    for hi in range(1, len(lengths) + 1):
        if hi == len(lengths) or hi - lo >= batch or lengths[hi] * (hi + 1 - lo) > CELLS:
            yield lo, hi
            lo = hi


def extract(model: Labeller, pages: list[str | None], batch: int = 128) -> list[str]:
    """Main text of each page; empty if it has none."""
    split = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if split[i]), key=lambda i: len(split[i]))
    for lo, hi in _batches([len(split[i]) for i in order], batch):
        chosen = order[lo:hi]
        for i, z in zip(chosen, model.logits([vectors(split[i]) for i in chosen]), strict=True):
            out[i] = " ".join(b[1] for b, keep in zip(split[i], z > 0, strict=True) if keep)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null html counts as empty and gives an empty text. Whole pages are read, however long or deep, once from left to
    right; repeated rows and ids give repeated rows; other columns are dropped. An empty table gives an empty result. No
    shuffle but the ordering of the fit's sample.
    """
    text_batches(pages.sparkSession)
    model = share(pages.sparkSession, fit_labeller(pages, id_col, html_col).p)
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        labeller = Labeller()
        labeller.p = model.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = extract(labeller, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(lean(run), schema)
