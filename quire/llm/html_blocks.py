"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block has a vector of its tag
path (element names and the words of class and id, hashed), its words (hashed) and a few sizes; a
bidirectional LSTM in numpy reads the sequence and labels every block in the
light of the whole page. The labeller is trained here, in the driver, with Adam: on page
layouts that a generator composes (menus, notices, adverts, side columns, reader
comments, article bodies under many names) with text of a bounded sample of the pages,
and on those pages themselves, whose own sectioning elements give weak labels. Training is
seeded, so equal pages give equal models.

Scripts, styles, forms, templates and comments of the markup never become blocks; elements nested deeper than
browsers allow (512) count as siblings, and a path has its nearest 64 names.
Character references are decoded, white space inside a block becomes one space, and
the blocks kept are joined by two line feeds in page order; nothing is cut.

Pages are independent: nothing is shuffled but the sample's order. Null or empty html gives an empty
text; malformed markup is read as browsers do (unclosed and stray tags, unclosed quotes) and in linear time, so very
long pages are read like any other; repeated rows give repeated results; an empty table gives an empty result; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.kernel import words_of

#: A comment, a tag, or another declaration. Quotes count only after an equals sign; what the page's end cuts short goes to
#: the end. No part is ever scanned twice (possessive), so that malformed pages take linear time as well.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements (fixed values of the HTML standard).
RAW = frozenset("script style textarea title iframe noembed noframes template".split())
DROPPED = frozenset("head form select button option datalist".split())
#: Deepest nesting, as in browsers (what is deeper becomes a sibling), and names of a path that count, the nearest ones.
DEEPEST, NEAREST = 512, 64
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "li", "table"}}
PATH, WORDS, SIZES, HIDDEN = 48, 24, 10, 24
INPUT = PATH + WORDS + SIZES


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements, each with its path
    held: list[str] = []
    linked = dropped = anchors = 0

    def flush():
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else (), linked))
            held.clear()
        linked = 0

    def pop(to: int):
        nonlocal dropped, anchors
        for name, _ in stack[to:]:
            dropped -= name in DROPPED
            anchors -= name == "a"
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not dropped:
            held.append(page[at:stop])
            if anchors:
                linked += stop - at
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name or not m[4]:  # a tag that the page's end cuts short is no tag
            continue
        if m[1]:  # an end tag
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in RAW:
            close = _closing(name).search(page, at)
            at = close.end() if close else n
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
            closing = CLOSES.get(name, {"p"} if name != "p" else {"p"})
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closing or stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in STOPS.get(name, ()) or stack[k][0] in BLOCK and name not in CLOSES:
                    break
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        words = re.findall(r"[a-z]+", " ".join(a or b or c for a, b, c in NAMES.findall(m[3])).lower()) if "=" in m[3] else ()
        if name == "body":  # an unclosed head ends here
            pop(0)
        if len(stack) == DEEPEST:
            pop(DEEPEST - 1)
        own = (name, *(f".{w}" for w in words)) if name in BLOCK or words else ()
        stack.append((name, ((stack[-1][1] if stack else ()) + own)[-NEAREST:]))
        dropped += name in DROPPED
        anchors += name == "a"
    flush()
    return out


# ------------------------------------------------------------------- features

_SLOTS: dict[str, tuple[int, float]] = {}


def _slot(token: str) -> tuple[int, float]:
    if token not in _SLOTS:
        h = 2166136261
        for c in token.encode():
            h = (h ^ c) * 16777619 % (1 << 32)
        if len(_SLOTS) > 50_000:
            _SLOTS.clear()
        _SLOTS[token] = (h >> 8) % PATH, 1.0 if h & 1 else -1.0
    return _SLOTS[token]


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _PATHS:
        v = np.zeros(PATH, np.float32)
        for k, token in enumerate(reversed(path)):
            slot, sign = _slot(token)
            v[slot] += sign * (1.0 if k < 4 else 0.6)
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = v
    return _PATHS[path]


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """The vectors of all blocks of some pages, one page after the other."""
    every = [b for p in pages for b in p]
    x = np.zeros((len(every), INPUT), np.float32)
    if not every:
        return x
    for k, b in enumerate(every):
        x[k, :PATH] = _path_vector(b.path)
    texts = pa.array([b.text for b in every], pa.large_string())
    words = words_of(texts)
    count = np.diff(words.first)
    bag = np.bincount(words.doc() * WORDS + (words.hash >> np.uint64(40)).astype(np.int64) % WORDS, minlength=len(every) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = bag / np.maximum(count, 1)[:, None]
    chars = np.array([len(b.text) for b in every])
    place = np.concatenate([np.arange(len(p)) for p in pages])
    total = np.repeat([len(p) for p in pages], [len(p) for p in pages])
    size = x[:, PATH + WORDS :]
    size[:, 0] = np.log1p(chars) / 6
    size[:, 1] = np.log1p(count) / 5
    size[:, 2] = np.minimum(1, np.array([b.linked for b in every]) / np.maximum(chars, 1))
    size[:, 3] = place / np.maximum(total, 1)
    size[:, 4] = np.array([b.text[-1] in ".!?:\"”" for b in every])
    size[:, 5] = np.array(["©" in b.text for b in every])
    size[:, 6] = np.minimum(1, np.array([b.text.count(",") + b.text.count(".") for b in every]) / np.maximum(count, 1) * 4)
    size[:, 7] = chars < 40
    size[:, 8] = chars > 200
    size[:, 9] = 1
    return x


# ----------------------------------------------------------------------- LSTM


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights: for each direction the gates' matrix over input, state and bias; and the output layer."""

    gates: list[np.ndarray]
    out: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        gates = [rng.normal(0, 0.15, (INPUT + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        for g in gates:
            g[-1, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return cls(gates, rng.normal(0, 0.15, 2 * HIDDEN + 1).astype(np.float32))

    def _walk(self, x: np.ndarray, mask: np.ndarray, direction: int, keep: bool):
        """States (steps, pages, hidden) of a padded batch (steps, pages, input); padding leaves the state as it is."""
        steps, pages, _ = x.shape
        w = self.gates[direction]
        given = x.reshape(-1, INPUT) @ w[:INPUT] + w[-1]
        given = given.reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states, trace = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
            a = given[t] + h @ w[INPUT:-1]
            ifo = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                trace.append((t, h, c, i, f, o, g, tanh, m))
            c, h = np.where(m, new, c), np.where(m, o * tanh, h)
            states[t] = h
        return states, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = [self._walk(x, mask, d, False)[0] for d in range(2)]
        return np.concatenate(both, 2) @ self.out[:-1] + self.out[-1]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        walks = [self._walk(x, mask, d, True) for d in range(2)]
        states = np.concatenate([s for s, _ in walks], 2)
        p = _sigmoid(states @ self.out[:-1] + self.out[-1])
        d = (p - y) * mask / max(mask.sum(), 1)
        out = np.append(np.einsum("tp,tph->h", d, states), d.sum()).astype(np.float32)
        grads = []
        for k, (_, trace) in enumerate(walks):
            w, own = self.gates[k], self.out[k * HIDDEN : (k + 1) * HIDDEN]
            grad = np.zeros_like(w)
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh, m in reversed(trace):
                dh = dh + d[t][:, None] * own
                new = np.where(m, dc + dh * o * (1 - tanh * tanh), 0)
                do = np.where(m, dh * tanh, 0)
                a = np.concatenate([new * g * i * (1 - i), new * c * f * (1 - f), do * o * (1 - o), new * i * (1 - g * g)], 1)
                grad[:INPUT] += x[t].T @ a
                grad[INPUT:-1] += h.T @ a
                grad[-1] += a.sum(0)
                dh, dc = np.where(m, a @ w[INPUT:-1].T, dh), np.where(m, new * f, dc)
            grads.append(grad)
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / max(mask.sum(), 1)
        return [*grads, out], loss

    def label(self, pages: list[list[Block]], at_once: int = 256) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        x = vectors(pages)
        first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = np.argsort(np.diff(first), kind="stable")
        for k in range(0, len(order), at_once):
            some = order[k : k + at_once]
            length = np.diff(first)[some]
            if not length.max(initial=0):
                continue
            if length.max() * len(some) > 200_000 and len(some) > 1:  # long pages go alone
                parts = [[s] for s in some]
            else:
                parts = [some]
            for part in parts:
                size = np.diff(first)[part]
                batch, mask = _padded([x[first[p] : first[p + 1]] for p in part], size)
                found = self.logits(batch, mask) > 0
                for n, p in enumerate(part):
                    out[p] = found[: size[n], n]
        return out


def _padded(rows: list[np.ndarray], size) -> tuple[np.ndarray, np.ndarray]:
    steps = max(int(max(size)), 1)
    batch, mask = np.zeros((steps, len(rows), INPUT), np.float32), np.zeros((steps, len(rows)), bool)
    for k, r in enumerate(rows):
        batch[: len(r), k] = r
        mask[: len(r), k] = True
    return batch, mask


# ------------------------------------------------------------------- training

OUTSIDE = frozenset("nav footer aside header menu dialog".split())
INSIDE = frozenset("article main".split())
#: Class and id words of page parts (fixed values: common names in public page templates).
PARTS = {
    "menu": ("nav", ["menu", "navigation", "navbar", "breadcrumb", "topbar", "links", "nav"]),
    "header": ("header", ["header", "masthead", "banner", "logo", "branding", "top"]),
    "side": ("aside", ["sidebar", "related", "widget", "rail", "recommended", "popular", "side"]),
    "advert": ("div", ["ad", "ads", "advert", "sponsored", "promo", "advertisement"]),
    "notice": ("div", ["cookie", "notice", "consent", "alert", "popup", "newsletter", "subscribe", "banner"]),
    "comment": ("section", ["comments", "comment", "replies", "discussion", "responses", "respond"]),
    "footer": ("footer", ["footer", "copyright", "legal", "colophon", "bottom"]),
}
BODIES = ["content", "post", "entry", "story", "article", "text", "body", "main"]
SAMPLE_WORDS = "the of and to in is that for it was on are with as be this have from or by one had not but what all were when we there can an your which their said".split()


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """What a page's sectioning elements say; None if it has none."""
    inside = np.array([bool(INSIDE & {*b.path}) and not OUTSIDE & {*b.path} and not any(w in b.path for p in PARTS.values() for w in (f".{x}" for x in p[1])) for b in page])
    return inside if inside.any() else None


def layout(rng: np.random.Generator, lines: list[str]) -> tuple[list[Block], np.ndarray]:
    """A composed page and the label of each block."""
    say = lambda low, high: " ".join(lines[int(rng.integers(len(lines)))].split()[: int(rng.integers(low, high))]) or "Text."
    named = rng.random() < 0.8  # else no part has a telling name
    blocks, labels = [], []

    def add(text, path, linked=0.0, main=False):
        blocks.append(Block(text, ("html", "body", *path), int(linked * len(text))))
        labels.append(main)

    def part(kind, outer=()):
        element, words = PARTS[kind]
        own = [element] if rng.random() < 0.6 else ["div"]
        if own == ["div"] and named:
            own.append("." + words[int(rng.integers(len(words)))])
        if kind in ("menu", "side") and rng.random() < 0.8:
            for _ in range(int(rng.integers(2, 9))):
                add(say(1, 5), (*outer, *own, "ul", "li"), 1.0)
        elif kind == "comment":
            for _ in range(int(rng.integers(1, 5))):
                if rng.random() < 0.5:
                    add(say(1, 4), (*outer, *own, "div"), 0.5)
                add(say(4, 60), (*outer, *own, *(["ol", "li"] if rng.random() < 0.4 else ["div"]), "p"))
        else:
            for _ in range(int(rng.integers(1, 3))):
                text = say(3, 25)
                add(f"© {text}" if kind == "footer" and rng.random() < 0.6 else text, (*outer, *own, *(["p"] if rng.random() < 0.3 else [])), float(rng.random() < 0.3))

    for kind, chance in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("advert", 0.5), ("side", 0.2)):
        if rng.random() < chance:
            part(kind)
    body = ["article"] if rng.random() < 0.5 else ["main"] if rng.random() < 0.3 else ["div", "." + BODIES[int(rng.integers(len(BODIES)))]] if named else ["div"]
    body = ["div"] * int(rng.integers(0, 2)) + body
    if rng.random() < 0.8:
        add(say(3, 14), (*body, "h1"), 0, True)
    for _ in range(int(rng.integers(1, 16))):
        if rng.random() < 0.07:
            part("advert", body)
        kind = rng.random()
        path = (*body, "h2") if kind < 0.08 else (*body, "ul", "li") if kind < 0.16 else (*body, "blockquote", "p") if kind < 0.2 else (*body, "p")
        add(say(2, 12) if kind < 0.08 else say(2, 120), path, 0.1 * (rng.random() < 0.2), True)
    for kind, chance in (("comment", 0.35), ("side", 0.4), ("advert", 0.3), ("notice", 0.2), ("footer", 0.85)):
        if rng.random() < chance:
            part(kind, body if kind == "comment" and rng.random() < 0.2 else ())
    return blocks, np.array(labels)


def train(pages: list[list[Block]], steps: int = 320, batch: int = 32, seed: int = 7, most_lines: int = 20_000, most_blocks: int = 200) -> Labeller:
    """Adam on composed layouts with the words of at most ``most_lines`` blocks, and on the given pages of at most ``most_blocks`` blocks that have sectioning elements."""
    rng = np.random.default_rng(seed)
    lines = [b.text for p in pages for b in p][:most_lines] + [" ".join(rng.choice(SAMPLE_WORDS, 40)) + "." for _ in range(50)]
    real = [(p, y) for p in pages if p and (y := weak_labels(p)) is not None and len(p) <= most_blocks]
    model = Labeller.new(seed)
    weights = [*model.gates, model.out]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        some = [layout(rng, lines) for _ in range(batch * 2 // 3 if real else batch)]
        some += [real[int(k)] for k in rng.integers(0, len(real), batch - len(some))] if real else []
        x, size = vectors([p for p, _ in some]), [len(p) for p, _ in some]
        first = np.concatenate([[0], np.cumsum(size)])
        rows = [x[i:j] for i, j in zip(first[:-1], first[1:])]
        xs, mask = _padded(rows, size)
        y = np.zeros(mask.shape, np.float32)
        for k, (_, own) in enumerate(some):
            y[: len(own), k] = own
        grads, _ = model.gradients(xs, mask, y)
        rate = 0.01 * min(1, 2 * (steps - step + 1) / steps)
        for w, g, m, s in zip(weights, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(pages: DataFrame, sample: int = 200, longest: int = 200_000) -> Labeller:
    """Trains on at most ``sample`` pages (by hash of the id) of at most ``longest`` characters."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).where(F.char_length("html") <= longest)
    chosen = own.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()  # ids first: the html of the sample alone goes to the driver
    rows = own.join(F.broadcast(chosen), "page_id").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(sample).collect()
    return train([blocks_of(r.html) for r in rows])


RESULT = "page_id bigint, url string, text string, n_chars bigint, blocks array<string>"


def main_text(pages: DataFrame, model: Labeller, at_once: int = 256) -> DataFrame:
    """page_id, url, text, n_chars and the kept blocks of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                found = [blocks_of(x or "") for x in part.column(2).to_pylist()]
                kept = [[b.text for b, y in zip(p, own) if y] for p, own in zip(found, shared.value.label(found))]
                texts = ["\n\n".join(x) for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(kept, pa.list_(pa.string()))], names=["page_id", "url", "text", "n_chars", "blocks"]
                )

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, RESULT)
