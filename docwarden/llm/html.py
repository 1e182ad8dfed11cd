"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks, each with its tag path and its text. A bidirectional LSTM in numpy reads, for
every block, a hashed vector of the path, one of the words and a few figures, and labels the block as main text or
not, knowing the whole page in both directions.
"""

from __future__ import annotations

import html as html_lib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_SIZE, WORD_SIZE, FIGURES = 256, 64, 8
HIDDEN = 24
#: Different pages that mark their main text, chosen by a hash of the page, that a labeller is fitted on at most.
FIT_PAGES = 400
#: Longer pages are learnt in windows of so many blocks.
WINDOW = 160
#: Blocks whose vectors are kept between the rounds of a fit; of more, they are made again each time.
KEPT_BLOCKS = 100_000

# Element names of the markup language by what they do to blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1"
    " h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td"
    " tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head iframe math noembed noframes noscript object script style svg template textarea title".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: What can stand in a head; any other element ends an open one, as text does.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of other vocabularies, which "/>" closes.
FOREIGN = frozenset({"svg", "math"})
#: An element of the first kind ends open ones of the second, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z0-9]+")
#: Attributes whose last slash belongs to a value without quotes, and does not close the element.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"']*/\Z")


def _path_words(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name, and the words of its class, id and role."""
    if not attributes:
        return (name,)
    found = _NAMES.findall(attributes)
    return (name, *dict.fromkeys("." + w for values in found for v in values for w in _NAME.findall(v.lower())))


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order. Entities are decoded, white space is one space, markup and unseen elements are gone."""
    page = page or ""
    low = None
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, hidden, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(w for _, words in stack for w in words), text, linked))
            parts.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal hidden
        if any(name in BLOCK for name, _ in stack[n:]):
            flush()
        hidden -= sum(name in UNSEEN for name, _ in stack[n:])
        del stack[n:]

    def text_to(end: int) -> None:
        nonlocal linked
        if end <= at:
            return
        if hidden and stack[-1][0] == "head" and not page[at:end].isspace():
            pop(len(stack) - 1)
        if not hidden:
            said = html_lib.unescape(page[at:end])
            parts.append(said)
            if any(name == "a" for name, _ in stack):
                linked += len(said)

    while True:
        m = _TAG.search(page, at)
        text_to(m.start() if m else len(page))
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                # An inline element does not end what a block began.
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            else:
                if name == "p":
                    flush()
            continue
        if stack and stack[-1][0] == "head":
            if name in ("html", "head"):
                continue
            if name not in IN_HEAD:
                pop(len(stack) - 1)
        if name == "br":
            if not hidden:
                parts.append(" ")
            continue
        if name in BLOCK:
            ended, bound = ENDS.get(name, (set(), set()))
            for i in range(len(stack) - 1, -1, -1):
                # A block begins: an open paragraph is over, and so are items of the same list.
                if stack[i][0] == "p" or stack[i][0] in ended:
                    pop(i)
                    break
                if stack[i][0] in bound or (not ended and stack[i][0] in BLOCK):
                    break
            flush()
        if name in VOID:
            continue
        closed = m["attributes"].endswith("/") and not _VALUE_SLASH.search(m["attributes"])
        if closed and (name in FOREIGN or any(n in FOREIGN for n, _ in stack)):
            continue
        if name in RAW:
            if low is None:
                low = page.lower()
                low = low if len(low) == len(page) else page
            end = low.find("</" + name, at)
            at = len(page) if end < 0 else end
        if name in UNSEEN:
            hidden += 1
        stack.append((name, _path_words(name, m["attributes"])))
    flush()
    return out


def _hash(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def vectors(blocks: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """One row per block: hashed path, hashed words, figures. ``blocks`` begin at ``first`` in a page of ``of`` blocks."""
    of = len(blocks) if of is None else of
    x = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + FIGURES), np.float32)
    for i, b in enumerate(blocks):
        for w in b.path:
            x[i, _hash(w, PATH_SIZE)] = 1
        words = b.text.split()
        n = len(b.text)
        if words:
            counts = np.bincount([_hash(w, WORD_SIZE) for w in words], minlength=WORD_SIZE)
            x[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt((counts**2).sum())
        x[i, PATH_SIZE + WORD_SIZE :] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, b.linked / max(1, n), sum(map(b.text.count, ".,;:")) / max(1, len(words)),
            n / max(1, len(words)) / 20, (first + i) / max(1, of), len(b.path) / 16, float(b.text[-1:] in ".!?"),
        )
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @staticmethod
    def new(rng: np.random.Generator) -> Labeller:
        size = PATH_SIZE + WORD_SIZE + FIGURES
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.1, (size, 4 * HIDDEN))
            p["h" + d] = rng.normal(0, 0.5 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p["c" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        p["o"] = rng.normal(0, 0.1, 2 * HIDDEN)
        p["o0"] = np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction over (pages, blocks, features); ``mask`` is 1 where a page has a block."""
        n, t, _ = x.shape
        pre = (x.reshape(n * t, -1) @ self.p["x" + d]).reshape(n, t, -1) + self.p["c" + d]
        h = c = np.zeros((n, HIDDEN), np.float32)
        hs = np.zeros((n, t, HIDDEN), np.float32)
        trail = []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = pre[:, k] + h @ self.p["h" + d]
            i, f, o = (_sigmoid(g[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            was_h, was_c = h, c
            raw = f * c + i * u
            c = m * raw + (1 - m) * c
            th = np.tanh(raw)
            h = m * o * th + (1 - m) * h
            hs[:, k] = h
            if keep:
                trail.append((k, i, f, o, u, th, was_h, was_c, m))
        return hs, trail

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        return np.concatenate([hf, hb], 2) @ self.p["o"] + self.p["o0"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, t, size = x.shape
        run = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([run["f"][0], run["b"][0]], 2)
        slope = (_sigmoid(both @ self.p["o"] + self.p["o0"]) - y) * mask / max(1.0, mask.sum())
        g = {"o": np.einsum("nt,nth->h", slope, both), "o0": slope.sum(keepdims=True).reshape(1)}
        for j, d in enumerate("fb"):
            to_h = slope[:, :, None] * self.p["o"][j * HIDDEN : (j + 1) * HIDDEN]
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            pre = np.zeros((n, t, 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(self.p["h" + d])
            for k, i, f, o, u, th, was_h, was_c, m in reversed(run[d][1]):
                dh = dh + to_h[:, k]
                live = dh * m
                raw = dc * m + live * o * (1 - th**2)
                a = np.concatenate([raw * u * i * (1 - i), raw * was_c * f * (1 - f), live * th * o * (1 - o), raw * i * (1 - u**2)], 1)
                pre[:, k] = a
                dwh += was_h.T @ a
                dh = dh * (1 - m) + a @ self.p["h" + d].T
                dc = dc * (1 - m) + raw * f
            flat = pre.reshape(n * t, -1)
            g["x" + d], g["h" + d], g["c" + d] = x.reshape(n * t, size).T @ flat, dwh, flat.sum(0)
        return g

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Labeller:
        with np.load(io.BytesIO(data)) as z:
            return Labeller({k: z[k] for k in z.files})


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, pages[0].shape[1]), np.float32), np.zeros((len(pages), t), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# What pages call their parts. Main text is taught from pages that mark it as an article; the other names are put on
# copies of such pages, so that the labeller knows them too.
MAIN_NAMES = ("content", "post", "entry", "story", "main", "text", "article", "body")
OTHER_NAMES = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form",
    "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "recommended",
    "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget", "alert", "copyright", "discussion", "responses", "reader", "readers", "aside", "teaser", "tags",
)
OTHER_TAGS = frozenset("nav header footer aside form button label select option menu dialog legend fieldset search".split())
_OTHER = frozenset("." + n for n in OTHER_NAMES)


def taught(b: Block) -> bool:
    """Main text as pages that mark it tell: inside an article or main element, and in nothing that is named otherwise."""
    return ("article" in b.path or "main" in b.path) and not any(w in OTHER_TAGS or w in _OTHER for w in b.path)


def varied(blocks: list[Block], labels: list[bool], said: list[str], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A copy of a page that names its parts in another way and has further parts with words of other pages."""
    pick = lambda names: str(names[rng.integers(len(names))])
    names = {
        "article": rng.choice(3), "outer": ("div", "section", "main")[rng.integers(3)],
        "name": "." + pick(MAIN_NAMES),
    }
    out, marks = [], []
    for b, main in zip(blocks, labels, strict=True):
        path = list(b.path)
        if "article" in path and names["article"]:
            i = path.index("article")
            path[i : i + 1] = [names["outer"], names["name"]] if names["article"] == 1 else ["article", names["name"]]
        for i, w in enumerate(path):
            if w in ("nav", "footer", "header", "aside") and rng.random() < 0.4:
                path[i : i + 1] = ["div", "." + pick(OTHER_NAMES)]
                break
        out.append(Block(tuple(path), b.text, b.linked))
        marks.append(main)
    inside = [i for i, m in enumerate(marks) if m]
    for _ in range(int(rng.integers(1, 5))):
        at = int(rng.integers(0, len(out) + 1))
        if inside and rng.random() < 0.4:
            at = int(rng.integers(inside[0], inside[-1] + 2))
        base = list(out[min(at, len(out) - 1)].path) if out and rng.random() < 0.6 else ["html", "body"]
        while base and (base[-1] in ("p", "h1", "h2", "h3", "li", "b", "a") or base[-1].startswith(".") and rng.random() < 0.2):
            base.pop()
        tag = pick(("div", "div", "section", "aside", "ul", "form", "nav", "header", "footer"))
        box = [*base, tag, *(["." + pick(OTHER_NAMES)] if tag in ("div", "section", "ul") or rng.random() < 0.5 else [])]
        new = []
        for _ in range(int(rng.integers(1, 6))):
            text = pick(said)
            words = text.split()
            text = " ".join(words[: int(rng.integers(1, 40))]) or "x"
            inner = ([], ["p"], ["li"], ["li", "a"], ["button"], ["label"], ["h3"], ["div", ".author"])[rng.integers(8)]
            new.append(Block((*box, *inner), text, len(text) if "a" in inner else 0))
        out[at:at], marks[at:at] = new, [False] * len(new)
        inside = [i for i, m in enumerate(marks) if m]
    return out, marks


def fitted(pages: list[str], epochs: int = 8, batch: int = 16, rate: float = 0.01) -> Labeller:
    """A labeller taught by pages that mark their article; the same for the same pages in the same order.

    Without any such page nothing can be taught, and the labeller keeps every block.
    """
    rng = np.random.default_rng(0)
    model = Labeller.new(rng)
    parsed = [b for b in map(blocks_of, pages) if b]
    said = [b.text for page in parsed for b in page]
    shown = []
    for page in parsed:
        labels = [taught(b) for b in page]
        if any(labels):
            shown.append((page, labels))
            shown += [varied(page, labels, said, rng) for _ in range(2)]
    if not shown:
        return Labeller({k: np.ones_like(v) if k == "o0" else np.zeros_like(v) for k, v in model.p.items()})
    # Where a block stands is told by the whole page, also in a window.
    shown = [(b[i : i + WINDOW], i, len(b), np.array(m[i : i + WINDOW], np.float32)) for b, m in shown for i in range(0, len(b), WINDOW)]
    kept = [vectors(*s[:3]) for s in shown] if sum(len(s[3]) for s in shown) <= KEPT_BLOCKS else None
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        # Pages of like length together, the groups in any order.
        order = sorted(rng.permutation(len(shown)).tolist(), key=lambda i: len(shown[i][0]) // 8)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([kept[i] if kept else vectors(*shown[i][:3]) for i in groups[g]])
            y = np.zeros_like(mask)
            for r, i in enumerate(groups[g]):
                y[r, : len(shown[i][3])] = shown[i][3]
            step += 1
            for k, d in model.gradients(x, mask, y).items():
                d = np.clip(d, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * d
                square[k] = 0.99 * square[k] + 0.01 * d * d
                model.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def marked(page: str | None) -> bool:
    return any(map(taught, blocks_of(page)))


def fit(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> bytes:
    """A labeller fitted in one task on up to ``fit_pages`` different pages of those that mark their main text; only the model comes to the driver.

    They are those of smallest hash among all marked pages of the table, whatever share of it they are; copies of a page are
    one. If no page is marked, the labeller keeps every block.
    """
    able = pages.where(F.col(html_col).rlike("(?i)<(article|main)")).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))

    def chosen(hashes: DataFrame) -> DataFrame:
        least = hashes.select("h").distinct().orderBy("h").limit(fit_pages)
        return able.join(F.broadcast(least), "h").groupBy("h").agg(F.min("html").alias("html"))

    def train(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [h for b in batches for h in b["html"].to_pylist()]
            done = last or all(map(marked, rows))
            yield pa.record_batch({"model": pa.array([fitted(rows).to_bytes() if done else None], pa.binary())})

        return run

    def trained(hashes: DataFrame, last: bool) -> bytes | None:
        made = chosen(hashes).repartition(1).sortWithinPartitions("h", "html").mapInArrow(train(last), "model binary").first()
        return made["model"] if made else fitted([]).to_bytes()

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([marked(h) for h in b["html"].to_pylist()], pa.bool_())).select(["h"])

    # A tag may stand in a comment, or in a part named otherwise. Where the first pages all mark main text, they are the
    # first that do; else all pages with such a tag are looked at.
    return trained(able, False) or trained(able.mapInArrow(telling, "h long"), True)


def main_texts(pages: list[str | None], model: Labeller, together: int = 32) -> list[str]:
    """Main text of each page, blocks joined by an empty line; empty if there is none."""
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    start = 0
    while start < len(order):
        group = order[start : start + together]
        # Very long pages go alone.
        while len(group) > 1 and len(parsed[group[-1]]) * len(group) > 20_000:
            group = group[: len(group) // 2]
        start += len(group)
        x, mask = padded([vectors(parsed[i]) for i in group])
        main = model.logits(x, mask) > 0
        for r, i in enumerate(group):
            out[i] = "\n\n".join(b.text for b, m in zip(parsed[i], main[r], strict=False) if m)
    return out


def extract(pages: DataFrame, model: bytes, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of each; null and empty pages have an empty one."""
    loaded: list[Labeller] = []

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(Labeller.from_bytes(model))
        texts = list(texts)
        return pd.Series([t for i in range(0, len(texts), 512) for t in main_texts(texts[i : i + 512], loaded[0])], dtype=object)

    return pages.withColumn(to, of(F.col(html_col)))
