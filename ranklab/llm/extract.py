"""Operator 1: main text of web pages by a recurrent block labeller.

Parsing (map-only, per page): markup becomes the sequence of leaf blocks, the text between borders of block-level elements, each
with its tag path (tags, class and id words). Unclosed and misnested elements, cut pages, stray ``<`` and stray quotes are tolerated; scripts, styles,
comments, titles and the fallback text of iframes are never text, and nothing else is left out. Character references are decoded and white space inside a block (``<br>`` included) becomes one
space.

Labelling: a bidirectional LSTM (numpy) reads the whole page's sequence. A block's input is its hashed tag path, its hashed words and a few
rates (length, links, digits, punctuation, position). Every block is so classified with the context of the whole document; the
main blocks are joined in page order.

Training: the labeller is fitted by back-propagation on ``TRAIN_PAGES`` generated pages (``training_pages``) whose blocks are known: menus,
headers, notices, adverts, sidebars, forms, comments and footers around and inside articles, in many notations. The fit is deterministic and takes
seconds on the driver; it reads none of the table.

Defined results: a null or empty page, or one without a main block, has empty text; very long pages are read whole; repeated rows give equal rows;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import in_tasks, register, table
from ranklab.llm.words import code_of, slices

TRAIN_PAGES = 1500
EPOCHS = 9
HIDDEN = 16
PATH_BUCKETS = 192
WORD_BUCKETS = 64
RATES = 10
MARK = ""            # marks main blocks of generated pages

# Elements of the HTML standard.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section "
                  "select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
NOT_IN_P = BLOCK - frozenset("button label option optgroup select textarea".split())

# What stands in a tag after its name. Only a quote after = opens a value; one that holds < or > must end where a value can end, or the quote
# is a stray one. Possessive: every character is passed once.
VALUE_END = r"""(?=[\s>]|/\s*>|[a-z][\w:-]*\s*=\s*["']|\Z)"""
INSIDE = rf"""(?:[^<>=]++|=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|"[^"]*+"{VALUE_END}|'[^']*+'{VALUE_END})?+)*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|title|iframe)(?=[\s>]|/(?!>)){INSIDE}(?<![\s"']/)>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)"""
    rf"""|<(/?)([a-z][a-z0-9:-]*+)({INSIDE})(?:(>)|\Z|(?=<))|<[!?][^>]*(?:>|\Z)|(</)""", re.S | re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Memo(dict):
    """A function with its latest results, at most ``most`` of them; it travels to tasks without them."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most = fn, most

    def __call__(self, *key):
        value = self.get(key)
        if value is None:
            if len(self) >= self.most:
                self.clear()
            value = self[key] = self.fn(*key)
        return value

    def __reduce__(self):
        return Memo, (self.fn, self.most)


def _step(tag: str, attributes: str) -> tuple:
    """A path step: the tag, and the words of its class, id and role."""
    named = " ".join(" ".join(x) for x in NAMED.findall(attributes)) if "=" in attributes else ""
    return tag, (tag, *dict.fromkeys("." + p.lower() for p in PIECES.findall(named)))


def _mask(names: tuple) -> int:
    out = 0
    for n in names:
        out |= 1 << code_of(n.encode()) % PATH_BUCKETS
    return out


_tokens, _masks = Memo(_step, 4096), Memo(_mask, 4096)


class Path:
    """A tag path as its last step and the path before it, with the hashed cells of all steps as bits: paths share their prefixes."""
    __slots__ = ("before", "step", "mask")

    def __init__(self, before: Path | None, step: tuple):
        self.before, self.step = before, step
        self.mask = (before.mask if before else 0) | _masks(step)

    def last(self, n: int) -> list[tuple]:
        """The ``n`` innermost steps, the innermost first."""
        out, at = [], self
        while at is not None and len(out) < n:
            out.append(at.step)
            at = at.before
        return out

    def __iter__(self):
        return reversed(self.last(1 << 62))

    def __getitem__(self, i):
        return tuple(self)[i]


class _Open:
    """The open elements. Every question about the stack is answered from per-tag places, so none costs its depth."""

    def __init__(self):
        self.stack: list[tuple[str, Path]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []                     # places of block-level elements

    def push(self, tag: str, step: tuple) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, Path(self.stack[-1][1] if self.stack else None, step)))

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        return tag

    def innermost(self, tags) -> int:
        """Place of the innermost open element of one of the ``tags``, or -1."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def path(self) -> Path | None:
        return self.stack[-1][1] if self.stack else None


def blocks(page: str) -> list[tuple[Path | tuple, str, float]]:
    """(path, text, share of linked characters) of the page's leaf blocks in order."""
    out, parts = [], []
    stack = _Open()
    linked = total = links = 0
    path: Path | tuple | None = None
    at, last = 0, page.rfind(">")

    def flush():
        nonlocal linked, total, path
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((path, text, linked / max(total, 1)))
            parts.clear()
        linked = total = 0
        path = None

    def add(text):
        nonlocal linked, total, path
        if path is None:
            if text.isspace():
                return
            path = stack.path() or ()
        parts.append(text)
        total += len(text)
        if links:
            linked += len(text)

    def pop_to(i):
        nonlocal links
        while len(stack.stack) > i:
            t = stack.pop()
            if t in BLOCK:
                flush()
            elif t == "a":
                links -= 1

    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m[6]:                               # an end without a name, up to the next >, if there is one
            if at <= last:
                at = page.index(">", at) + 1
            else:
                add(m[0])
            continue
        tag = m[3]
        if tag is None:
            continue
        if not m[5] and at < len(page):        # a < that opens no tag
            add(m[0])
            continue
        tag = tag.lower()
        if m[2]:
            if (i := stack.innermost((tag,))) >= 0:
                pop_to(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in NOT_IN_P and stack.blocks and stack.stack[stack.blocks[-1]][0] == "p":
                pop_to(stack.blocks[-1])
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                if (i := stack.innermost(ends)) > stack.innermost(scope):
                    pop_to(i)
        if not m[4].rstrip().endswith("/") or tag in BLOCK or tag == "a":
            stack.push(*_tokens(tag, m[4]))
            links += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out


# ------------------------------------------------------------------ inputs

def _cells(mask: int, tags: tuple) -> list[int]:
    """Hashed cells of a path: every token, and the innermost tags by depth."""
    mask |= _mask(tuple(f"{i}:{t}" for i, t in enumerate(tags)))
    return [i for i in range(PATH_BUCKETS) if mask >> i & 1]


_path_cells = Memo(_cells, 20_000)


def inputs(sequence: list) -> np.ndarray:
    """(blocks, features) of one or more pages' blocks; positions are filled in by ``page_inputs``."""
    n = len(sequence)
    x = np.zeros((n, PATH_BUCKETS + WORD_BUCKETS + RATES), np.float32)
    for i, (path, _, _) in enumerate(sequence):
        if path:
            x[i, _path_cells(path.mask, tuple(s[0] for s in path.last(3)))] = 1
    texts = pa.array([t for _, t, _ in sequence], pa.string())
    at = PATH_BUCKETS
    for s in slices(texts, lower=True):
        row = s.row_of_word()
        bucket = (s.codes() % np.uint64(WORD_BUCKETS)).astype(np.int64)
        counts = np.bincount(row * WORD_BUCKETS + bucket, minlength=(s.hi - s.lo) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
        x[s.lo:s.hi, at:at + WORD_BUCKETS] = counts / np.sqrt(np.maximum(s.n_words, 1))[:, None]
        size = np.maximum(np.diff(s.offsets), 1)
        r = x[s.lo:s.hi, at + WORD_BUCKETS:]

        def share(mask, s=s, size=size):
            return np.diff(np.concatenate(([0], np.cumsum(mask)))[s.offsets]) / size
        r[:, 0] = np.log1p(size) / 5
        r[:, 1] = np.log1p(s.n_words) / 4
        r[:, 3] = share((s.buf >= 0x30) & (s.buf <= 0x39))
        r[:, 4] = 5 * share(np.isin(s.buf, [0x21, 0x2C, 0x2E, 0x3A, 0x3B, 0x3F]))
        last = s.buf[np.maximum(s.offsets[1:] - 1, 0)] if len(s.buf) else np.zeros(s.hi - s.lo, np.uint8)
        r[:, 5] = np.isin(last, [0x2E, 0x21, 0x3F])
    x[:, at + WORD_BUCKETS + 2] = [k for _, _, k in sequence]
    return x


def with_places(x: np.ndarray, k: np.ndarray, n) -> np.ndarray:
    """``x`` with the positions ``k`` of its blocks on pages of ``n`` blocks."""
    x[:, -4], x[:, -3], x[:, -2], x[:, -1] = k / np.maximum(1, n - 1), np.exp(-k / 3), np.exp(-(n - 1 - k) / 3), np.log1p(n) / 4
    return x


def page_inputs(pages: list[list]) -> list[np.ndarray]:
    n = np.array([len(p) for p in pages])
    lo = np.cumsum(n) - n
    x = with_places(inputs([b for p in pages for b in p]), np.arange(n.sum()) - np.repeat(lo, n), np.repeat(n, n))
    return [x[i:i + k] for i, k in zip(lo, n)]


# ------------------------------------------------------------------ the network

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x, mask, w, u, b, keep=False):
    """One direction over (steps, pages, features): hidden states, and what the gradient needs."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    pre = x @ w + b
    out, tape = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c2, c)
        out[t] = h
    return out, tape


def _backward(dh_out, x, tape, u):
    steps, n, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz_all, du = np.empty((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(u)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + dh_out[t]
        live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
        do = live_h * tc
        d2 = live_h * o * (1 - tc ** 2) + live_c
        dz = np.concatenate((d2 * g * i * (1 - i), d2 * c * f * (1 - f), do * o * (1 - o), d2 * i * (1 - g ** 2)), axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = np.where(m, 0, dh) + dz @ u.T, np.where(m, d2 * f, dc)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _stack(pages: list[np.ndarray]):
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, True
    return x, mask


def _logits(model, x, mask, keep=False):
    """Both directions; padding stands after a page's blocks, so the backward direction passes it with state zero."""
    hf, tf = _forward(x, mask, *model[0:3], keep)
    hb, tb = _forward(x[::-1], mask[::-1], *model[3:6], keep)
    h = np.concatenate((hf, hb[::-1]), axis=2)
    return h @ model[6] + model[7], h, tf, tb


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 3) -> list[np.ndarray]:
    """Adam on the mean block cross-entropy."""
    rng = np.random.default_rng(seed)
    d = pages[0].shape[1]

    def init(*shape):
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    model = [p for _ in range(2) for p in (init(d, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32))]
    model += [init(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32)]
    m1, m2, step = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model], 0
    size = np.array([len(p) for p in pages])
    for _ in range(epochs):
        order = np.argsort(size + rng.uniform(0, 8, len(size)))
        groups = [order[i:i + 24] for i in range(0, len(order), 24)]
        for k in rng.permutation(len(groups)):
            x, mask = _stack([pages[i] for i in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(groups[k]):
                y[:len(labels[i]), j] = labels[i]
            z, h, tf, tb = _logits(model, x, mask, keep=True)
            dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / mask.sum()
            dh = dz[:, :, None] * model[6]
            grads = [*_backward(dh[:, :, :HIDDEN], x, tf, model[1]), *_backward(dh[::-1, :, HIDDEN:], x[::-1], tb, model[4]),
                     np.einsum("tn,tnh->h", dz, h), dz.sum(keepdims=True)[0]]
            step += 1
            for p, g, a, b in zip(model, grads, m1, m2):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return model


def _projected(pages: list[list], model: list[np.ndarray], chunk: int) -> np.ndarray:
    """(blocks of all pages, 2, 4 * HIDDEN): what each block gives to the gates of both directions. Inputs are made ``chunk`` blocks at a
    time, so that a page's inputs are never held whole."""
    n = np.array([len(p) for p in pages])
    k, n = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)
    every = [b for p in pages for b in p]
    out = np.empty((len(every), 2, 4 * HIDDEN), np.float32)
    for i in range(0, len(every), chunk):
        x = with_places(inputs(every[i:i + chunk]), k[i:i + chunk], n[i:i + chunk])
        out[i:i + chunk, 0], out[i:i + chunk, 1] = x @ model[0] + model[2], x @ model[3] + model[5]
    return out


def _both_ways(pre: np.ndarray, mask: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Hidden states (steps, 2, pages, HIDDEN) of both directions run side by side; direction 1 reads ``pre`` from the end."""
    steps, _, n, _ = pre.shape
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    out = np.empty((steps, 2, n, HIDDEN), np.float32)
    whole = mask.all()
    for t in range(steps):
        b = steps - 1 - t
        z = h @ u
        z[0] += pre[t, 0]
        z[1] += pre[b, 1]
        gates = _sigmoid(z[..., :3 * HIDDEN])
        c2 = gates[..., HIDDEN:2 * HIDDEN] * c + gates[..., :HIDDEN] * np.tanh(z[..., 3 * HIDDEN:])
        h2 = gates[..., 2 * HIDDEN:] * np.tanh(c2)
        if whole:
            h, c = h2, c2
        else:
            m = np.stack((mask[t], mask[b]))[..., None]
            h, c = np.where(m, h2, h), np.where(m, c2, c)
        out[t, 0], out[b, 1] = h[0], h[1]
    return out


def main_blocks(pages: list[list], model: list[np.ndarray], cells: int = 1 << 22, chunk: int = 8192) -> list[np.ndarray]:
    """For each page's blocks: True where the block is main text. Pages of like length run together, ``cells`` gate inputs at most."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    u = np.stack((model[1], model[4]))
    while order:
        longest = len(pages[order[-1]])
        n = max(1, cells // (longest * 8 * HIDDEN))
        group, order = order[-n:], order[:-n]
        sizes = [len(pages[i]) for i in group]
        flat = _projected([pages[i] for i in group], model, chunk)
        pre, mask = np.zeros((longest, 2, len(group), 4 * HIDDEN), np.float32), np.zeros((longest, len(group)), bool)
        at = 0
        for j, k in enumerate(sizes):
            pre[:k, :, j], mask[:k, j] = flat[at:at + k], True
            at += k
        del flat
        h = _both_ways(pre, mask, u)
        z = h[:, 0] @ model[6][:HIDDEN] + h[:, 1] @ model[6][HIDDEN:] + model[7]
        for j, i in enumerate(group):
            out[i] = z[:sizes[j], j] > 0
    return out


# ------------------------------------------------------------------ generated training pages

# Class and id names that pages give to their parts.
PARTS = {
    "header": "header masthead top site-header page-header banner branding logo hero-bar",
    "nav": "menu navbar navigation nav main-nav topnav breadcrumb breadcrumbs links pagination pager toc",
    "notice": "cookie cookie-banner notice consent gdpr alert popup modal overlay newsletter announcement disclaimer",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense ad-box",
    "side": "sidebar side widget related related-posts recommended popular trending more-stories teaser rail author-box",
    "form": "search search-form login subscribe signup contact-form newsletter-form",
    "comments": "comments comment-list responses discussion disqus replies reader-comments feedback",
    "share": "share social follow share-buttons social-links tags meta",
    "footer": "footer copyright bottom site-footer page-footer legal imprint colophon",
    "main": "content post entry article-body story text post-content main body entry-content page-content maincontent article column",
}
PARTS = {k: v.split() for k, v in PARTS.items()}
PHRASES = {
    "notice": ["We use cookies to improve this site", "Accept all cookies", "This site uses cookies", "Subscribe to our newsletter"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer"], "side": ["Related", "Popular posts", "Read more", "About the author"],
    "comments": ["Comments", "Reader comments", "Reply", "Leave a reply", "3 comments"], "share": ["Share", "Tweet", "Follow us", "Print"],
    "footer": ["&copy; 2023 All rights reserved", "Privacy policy", "Terms of use", "&copy; 2021", "Contact"],
    "header": ["Welcome", "Home"], "nav": ["Home", "Next", "Previous", "Menu", "Contact", "Archive"], "form": ["Search", "Name", "E-mail", "Submit", "Password"],
}


class PageMaker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        letters = ["an", "the", "on", "er", "st", "tion", "ou", "le", "ré", "en", "ver", "sch", "ción", "que", "os", "la", "in", "ed", "ü", "ñ"]
        self.latin = ["".join(self.r.choice(letters, self.r.integers(1, 5))) for _ in range(600)]
        # other scripts, by their ranges of code points; the last two are written without spaces
        self.scripts = [(["".join(chr(c) for c in self.r.integers(lo, hi, self.r.integers(2, 10))) for _ in range(300)], gap, stop)
                        for lo, hi, gap, stop in ((0x430, 0x450, " ", "."), (0x3B1, 0x3CA, " ", "."), (0x627, 0x64B, " ", "."), (0x5D0, 0x5EB, " ", "."),
                                                  (0x905, 0x93A, " ", "।"), (0x3041, 0x3097, "", "。"), (0x4E00, 0x9FA6, "", "。"))]
        self.vocabulary, self.gap, self.stop = self.latin, " ", "."

    def chance(self, p):
        return self.r.random() < p

    def pick(self, xs):
        return xs[self.r.integers(len(xs))]

    def words(self, lo, hi):
        return self.gap.join(self.pick(self.vocabulary) for _ in range(self.r.integers(lo, hi)))

    def prose(self, lo=1, hi=6):
        return self.gap.join(self.words(4, 22).capitalize() + self.stop for _ in range(self.r.integers(lo, hi)))

    def attribute(self, kind):
        name = self.pick(PARTS[kind])
        if self.chance(0.2):
            name += " " + self.pick(["clearfix", "wide", "left", "box", "wrap", "container"])
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def wrap(self, kind, inner, tags, bare=0.25):
        tag = self.pick(tags)
        plain = tag in ("div", "section", "ul", "p", "span", "table")
        a = "" if not plain and self.chance(1 - bare) else self.attribute(kind)
        return f"<{tag}{a}>{inner}</{tag}>"

    def link(self, text):
        return f'<a href="/{self.pick(self.vocabulary)}">{text}</a>'

    def boiler(self, kind):
        say = (lambda: self.pick(PHRASES[kind]) if kind in PHRASES and self.chance(0.4) else self.words(1, 5))
        if kind == "nav":
            items = [self.link(say()) for _ in range(self.r.integers(2, 11))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.75) else " | ".join(items)
            return self.wrap(kind, inner, ["nav", "nav", "div", "div"])
        if kind == "header":
            return self.wrap(kind, f"<{'h1' if self.chance(.3) else 'div'}>{say()}</div>" + (f"<p>{self.words(3, 9)}</p>" if self.chance(.5) else ""), ["header", "header", "div"])
        if kind in ("notice", "ad"):
            body = self.prose(1, 3) if self.chance(0.7) else say()
            return self.wrap(kind, (f"<p>{body}</p>" if self.chance(.4) else body) + (f"<button>{say()}</button>" if self.chance(.2) else ""), ["div", "div", "section"], 1)
        if kind == "side":
            rows = "".join(f"<li>{self.link(self.words(2, 9))}</li>" if self.chance(.7) else f"<p>{self.prose(1, 3)}</p>" for _ in range(self.r.integers(1, 7)))
            return self.wrap(kind, (f"<h3>{say()}</h3>" if self.chance(.7) else "") + rows, ["aside", "aside", "div", "section"])
        if kind == "form":
            rows = "".join(f"<label>{say()}</label><input name=x>" for _ in range(self.r.integers(1, 4)))
            return self.wrap(kind, rows + f"<button>{say()}</button>" + (f"<p>{self.prose(1, 2)}</p>" if self.chance(.3) else ""), ["form"])
        if kind == "comments":
            each = "".join(f'<{t} class="comment"><b>{self.words(1, 3)}</b><p>{self.prose(1, 5)}</p></{t}>' if self.chance(.7) else f"<p>{self.prose(1, 4)}</p>"
                           for t in [self.pick(["div", "li", "article"])] for _ in range(self.r.integers(1, 6)))
            return self.wrap(kind, (f"<h3>{say()}</h3>" if self.chance(.8) else "") + each, ["section", "div", "div"], 1)
        if kind == "share":
            return self.wrap(kind, " ".join(self.link(say()) for _ in range(self.r.integers(1, 5))), ["div", "ul"], 1)
        body = say() + (" &middot; " + (self.prose(1, 3) if self.chance(.6) else self.link(say())))
        return self.wrap(kind, f"<p>{body}</p>" if self.chance(.4) else body, ["footer", "footer", "div"])

    def main(self):
        p = []
        if self.chance(0.85):
            p.append(f"<h1>{MARK}{self.words(3, 12).capitalize()}</h1>")
        for _ in range(self.r.integers(1, 13)):
            kind = self.r.random()
            text = MARK + (self.prose(1, 7) if self.chance(.85) else self.words(1, 9).capitalize() + self.pick([".", "", "!"]))
            if kind < 0.62:
                p.append(f"<p>{text}</p>")
            elif kind < 0.72:
                p.append(f"<p><b>{text}<br>")
            elif kind < 0.78:
                p.append(f"<h2>{MARK}{self.words(2, 7)}</h2>")
            elif kind < 0.84:
                p.append("<ul>" + "".join(f"<li>{MARK}{self.words(3, 14)}</li>" for _ in range(self.r.integers(2, 6))) + "</ul>")
            elif kind < 0.88:
                p.append(f"<blockquote>{text}</blockquote>" if self.chance(.5) else f"<pre>{text}</pre>")
            elif kind < 0.92:
                p.append(f"<div>{text}</div>")
            elif kind < 0.95:
                p.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                p.append(f"<p>{MARK}{self.prose(1, 3)} {self.link(self.words(1, 4))} {self.prose(1, 3)}</p>")
            if self.chance(0.06):
                p.append(self.boiler(self.pick(["ad", "share", "side", "notice"])))
        inner = "".join(p)
        shape = self.r.random()
        if shape < 0.4:
            return f"<article>{inner}</article>"
        if shape < 0.55:
            return f"<main>{inner}</main>" if self.chance(.5) else f"<main><article>{inner}</article></main>"
        if shape < 0.9:
            return f"<{(t := self.pick(['div', 'div', 'section']))}{self.attribute('main')}>{inner}</{t}>"
        return f"<div>{inner}</div>" if self.chance(.6) else inner

    def page(self):
        self.vocabulary, self.gap, self.stop = self.pick(self.scripts) if self.chance(0.3) else (self.latin, " ", ".")
        if self.chance(0.02):      # text without a tag
            return MARK + self.prose(1, 9)
        before = [self.boiler(k) for k, p in (("notice", .25), ("header", .4), ("nav", .75), ("form", .2), ("ad", .4), ("side", .15)) if self.chance(p)]
        after = [self.boiler(k) for k, p in (("share", .25), ("ad", .15), ("comments", .4), ("side", .35), ("form", .15), ("nav", .1), ("notice", .1), ("footer", .8)) if self.chance(p)]
        if self.chance(0.3):
            self.r.shuffle(before)
        body = "".join(before) + self.main() + "".join(after)
        end = "</body></html>" if self.chance(.85) else ""
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var t="</p>";</script></head><body>{body}{end}'


def training_pages(n: int, seed: int) -> tuple[list[list], list[np.ndarray]]:
    """Blocks of generated pages, and 1 for their main blocks."""
    maker = PageMaker(seed)
    pages, labels = [], []
    while len(pages) < n:
        b = blocks(maker.page())
        if b:
            labels.append(np.array([MARK in t for _, t, _ in b], np.float32))
            pages.append([(p, t.replace(MARK, "").strip() or "x", k) for p, t, k in b])
    return pages, labels


@functools.lru_cache(maxsize=2)
def fitted(n: int = TRAIN_PAGES, seed: int = 11) -> list[np.ndarray]:
    pages, labels = training_pages(n, seed)
    return train(page_inputs(pages), labels)


# ------------------------------------------------------------------ the operator

def _extract(batch, model):
    pages = [blocks(h) if h else [] for h in batch.column("html").to_pylist()]
    texts = ["\n".join(t for (_, t, _), k in zip(p, keep) if k) for p, keep in zip(pages, main_blocks(pages, model))]
    yield pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([len(p) for p in pages], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of every page."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = p.schema["page_id"].dataType.simpleString()
    return p.transform(in_tasks(_extract, f"page_id {kind}, url string, text string, n_chars long, n_blocks long", fitted()))


@register("op1_main_text")
def op1_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
