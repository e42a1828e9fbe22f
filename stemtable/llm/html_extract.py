"""HTML extraction: a recurrent labeller reads a page's leaf blocks and keeps the main text.

A page is cut into leaf blocks, the runs of text between block-level tags.  Each
block becomes a vector of its hashed tag path (tags, words of class and id), its
hashed words and a few sizes.  A bidirectional LSTM in numpy reads the whole
sequence of the page, so that every block is classified with the context of the
document, and the blocks labelled as main text are joined in page order.

Training needs no labels from outside: the blocks of a bounded sample of pages
(``SAMPLE``, least hash of the page id first, of at most ``SAMPLE_CHARS`` characters
each) are labelled where the markup itself tells (inside article or main, or inside
an element made for something else), and their texts are set into pages composed
from a list of usual containers, so that the labeller also knows structures that the
sample does not show.  One task trains; only its weights come to the driver.

Work grows with the length of a page, also of one nested without end: a path is a
number that knows its parent, and what it adds to the gates is worked out once.  Long
pages run through the network in stretches of ``STRETCH`` blocks with carried states.

Null and empty pages have an empty text.  Character references are decoded, white
space in a block becomes one space, nothing else is dropped or capped.  Broken
markup is read as browsers do in the common cases: a block-level start tag closes
an open paragraph, an end tag without a start is ignored, an open head ends at the
first tag or text that cannot stand in it.  Text of formulas, drawings and embedded
objects belongs to the block around it.  Repeated rows get equal results; the new
columns replace columns of their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import boxed, shipped, unboxed

SAMPLE = 300
COMPOSED = 900
SAMPLE_CHARS = 1_000_000
PATH_BITS, WORD_BITS = 10, 6
PATH, WORDS, SIZES = 1 << PATH_BITS, 1 << WORD_BITS, 6
HIDDEN = 16
EPOCHS = 10
BATCH = 24
# Blocks that are scored together, padding included.
BATCH_BLOCKS = 8_192
STRETCH = 1_024
# Paths that are remembered from page to page.
REMEMBERED = 50_000

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol option p pre"
    " section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
# Elements whose content is never text of the page.
HIDDEN_TAGS = frozenset("script style template head title".split())
# Tags that leave an open head open.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An opening tag of the first kind closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

CONTENT_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav header footer aside form button select textarea fieldset label noscript menu dialog".split())
# Class and id words of containers of main text and of other things, for composed pages.
CONTENT_WORDS = ("content", "post", "entry", "story", "article body", "main", "page content", "text", "post body", "blog post")
OTHER_WORDS = (
    "ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "cookie notice", "cookie banner", "consent",
    "notice", "alert", "popup", "modal", "sidebar", "side bar", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "header", "top bar", "footer", "copyright", "legal", "related", "recommended", "share", "social", "newsletter",
    "subscribe", "signup", "login", "search", "comments", "comment", "comment list", "replies", "disqus", "tags", "toolbar",
)


class Paths:
    """Tag paths as numbers; 0 is the empty one.

    For each: its parent, the places it adds to those of its parent, all places as
    a bit mask, its own tag, its depth, and what the markup tells of it.
    """

    def __init__(self):
        self.other = {w for words in OTHER_WORDS for w in name_words(words)} - {"top", "side", "list"}
        self.numbers: dict = {}
        self.parent, self.added, self.mask, self.tag, self.depth = [0], [()], [0], [""], [0]
        #: 1 main text, 0 something else, None nothing
        self.label: list[float | None] = [None]

    def child(self, parent: int, tag: str, names: tuple) -> int:
        key = (parent, tag, names)
        found = self.numbers.get(key)
        if found is None:
            words = [w for name in names for w in name_words(name)]
            places = {crc32(token.encode("utf-8", "replace")) & (PATH - 1) for token in (f"<{tag}", *words)}
            new = tuple(sorted(p for p in places if not self.mask[parent] >> p & 1))
            found = self.numbers[key] = len(self.parent)
            self.parent.append(parent)
            self.added.append(new)
            self.mask.append(self.mask[parent] | sum(1 << p for p in new))
            self.tag.append(tag)
            self.depth.append(self.depth[parent] + 1)
            label = self.label[parent]
            if label != 0.0 and tag in CONTENT_TAGS:
                label = 1.0
            elif tag in OTHER_TAGS or not self.other.isdisjoint(words):
                label = 0.0
            self.label.append(label)
        return found

    def leaf(self, path: int) -> int | None:
        """The place of a leaf's own tag, if the path does not have it already."""
        if not path:
            return None
        place = crc32(f"leaf {self.tag[path]}".encode()) & (PATH - 1)
        return None if self.mask[path] >> place & 1 else place

    def places(self, path: int) -> list[int]:
        leaf, out = self.leaf(path), []
        while path:
            out += self.added[path]
            path = self.parent[path]
        return out if leaf is None else [*out, leaf]


class BlockParser(HTMLParser):
    """Collects ``(path, text, characters in links)`` of each leaf block."""

    def __init__(self, paths: Paths):
        super().__init__(convert_charrefs=True)
        self.paths = paths
        self.blocks: list[tuple[int, str, int]] = []
        #: open elements: tag, class, id and role, path
        self.stack: list[tuple[str, tuple, int]] = []
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.links = 0

    @property
    def hidden(self) -> int:
        return sum(self.open[tag] for tag in HIDDEN_TAGS)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = self.stack[-1][2] if self.stack else 0
                self.blocks.append((path, text, min(self.linked, len(text))))
            self.parts.clear()
        self.linked = 0

    def push(self, tag: str, names: tuple = ()) -> None:
        self.stack.append((tag, names, self.paths.child(self.stack[-1][2] if self.stack else 0, tag, names)))
        self.open[tag] += 1

    def pop(self, upto: int) -> None:
        for tag, _, _ in self.stack[upto:]:
            self.open[tag] -= 1
        del self.stack[upto:]

    def leave_head(self) -> None:
        """End an open head, unless a template or title in it is open; its end tag is optional."""
        if self.open["head"] and self.hidden == self.open["head"]:
            others = [(tag, names) for tag, names, _ in self.stack if tag != "head"]
            self.pop(0)
            for tag, names in others:
                self.push(tag, names)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self.leave_head()
        if tag in HIDDEN_TAGS:
            self.flush()
            self.push(tag)
        elif tag == "body":
            # A body ends whatever was left open in the head.
            self.flush()
            self.pop(0)
            self._open(tag, attrs)
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        elif tag in BLOCK_TAGS:
            self.flush()
            self.links = 0
            if self.stack and self.stack[-1][0] == "p":
                self.pop(len(self.stack) - 1)
            for other in CLOSES.get(tag, ()):
                if self.stack and self.stack[-1][0] == other:
                    self.pop(len(self.stack) - 1)
            if tag not in VOID_TAGS:
                self._open(tag, attrs)

    def _open(self, tag, attrs) -> None:
        self.push(tag, tuple(v for k, v in attrs if v and k in ("class", "id", "role")))

    def handle_startendtag(self, tag, attrs):
        if tag == "br" or tag in VOID_TAGS:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCK_TAGS:
            self.leave_head()
            self.flush()

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
            self.flush()
            if self.open[tag]:
                upto = len(self.stack) - 1
                while self.stack[upto][0] != tag:
                    upto -= 1
                self.pop(upto)

    def handle_data(self, data):
        if self.hidden and data.strip(" \t\n\f\r"):
            self.leave_head()
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None, paths: Paths) -> list[tuple[int, str, int]]:
    if not html:
        return []
    parser = BlockParser(paths)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def name_words(name: str) -> list[str]:
    """Words of a class or id: cut at other characters than letters and at capitals, without a plural s."""
    parts = re.findall(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*", name)
    return [p.lower()[:-1] if len(p) > 3 and p.lower().endswith("s") else p.lower() for p in parts]


def features(page: list[tuple[int, str, int]], paths: Paths) -> np.ndarray:
    """What the labeller reads of each block besides its path: hashed words and sizes."""
    out = np.zeros((len(page), WORDS + SIZES), dtype=np.float32)
    for i, (path, text, linked) in enumerate(page):
        words = text.split()
        places = [crc32(w.encode("utf-8", "replace")) & (WORDS - 1) for w in words]
        out[i, :WORDS] = np.bincount(places, minlength=WORDS) / len(places)
        out[i, WORDS:] = (
            np.log1p(len(words)) / 6,
            linked / len(text),
            text.count(".") / len(words),
            paths.depth[path] / 8,
            i / len(page),
            1,
        )
    return out


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.weights = {
            f"{name}{side}": (rng.normal(0, scale, shape)).astype(np.float32)
            for side in (0, 1)
            for name, shape, scale in (
                ("p", (PATH, 4 * HIDDEN), 0.1),
                ("x", (WORDS + SIZES, 4 * HIDDEN), 0.1),
                ("h", (HIDDEN, 4 * HIDDEN), 0.2),
                ("b", (4 * HIDDEN,), 0.01),
            )
        }
        self.weights["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.weights["bias"] = np.zeros(1, dtype=np.float32)

    def _run(self, gates_in, mask, side, h, c, keep=False):
        """Some steps of one direction, the first one first: states (pages, steps, hidden), what the
        backward pass needs, and the last states."""
        w = self.weights[f"h{side}"]
        out = np.zeros((*mask.shape, HIDDEN), dtype=gates_in.dtype)
        trace = []
        for t in range(mask.shape[1]) if side == 0 else range(mask.shape[1] - 1, -1, -1):
            z = gates_in[:, t] + h @ w
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = m * (f * c + i * g)
            tc = np.tanh(c_new)
            h_new = m * o * tc
            if keep:
                trace.append((t, h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out, trace, h, c

    def gradients(self, x, places, paths, mask, target, weight, seen=None):
        """(loss, gradients) of the weighted logistic loss by back-propagation through the pages.

        ``places`` are the paths of the batch (rows of 0 and 1), ``paths`` the row of
        each block; blocks where ``seen`` is 0 go without their path.
        """
        w, n = self.weights, x.shape[0]
        seen = np.ones(mask.shape, dtype=x.dtype) if seen is None else seen
        zero = np.zeros((n, HIDDEN), dtype=x.dtype)
        states, traces = [], []
        for side in (0, 1):
            gates = x @ w[f"x{side}"] + w[f"b{side}"] + (places @ w[f"p{side}"])[paths] * seen[:, :, None]
            out, trace, _, _ = self._run(gates, mask, side, zero, zero, True)
            states.append(out)
            traces.append(trace)
        states = np.concatenate(states, axis=2)
        logits = states @ w["out"] + w["bias"]
        total = max(weight.sum(), 1)
        loss = float((weight * (np.logaddexp(0, logits) - target * logits)).sum() / total)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - target) * weight / total
        grads = {"out": np.einsum("bt,bth->h", error, states), "bias": np.array([error.sum()])}
        for side in (0, 1):
            d_out = error[:, :, None] * w["out"][side * HIDDEN : (side + 1) * HIDDEN]
            d_gates = np.zeros((*mask.shape, 4 * HIDDEN), dtype=x.dtype)
            d_h, d_c = zero, zero
            grad_h = np.zeros_like(w[f"h{side}"])
            for t, h, c, i, f, o, g, tc, m in reversed(traces[side]):
                d_h = (d_h + d_out[:, t]) * m
                d_c = (d_c + d_h * o * (1 - tc**2)) * m
                d_z = np.concatenate(
                    [d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g**2)], axis=1
                )
                d_gates[:, t] = d_z
                grad_h += h.T @ d_z
                d_c = d_c * f
                d_h = d_z @ w[f"h{side}"].T
            by_path = np.zeros((len(places), 4 * HIDDEN))
            np.add.at(by_path, paths, d_gates * seen[:, :, None])
            flat = d_gates.reshape(-1, 4 * HIDDEN)
            grads[f"p{side}"] = places.T @ by_path
            grads[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ flat
            grads[f"b{side}"] = flat.sum(axis=0)
            grads[f"h{side}"] = grad_h
        return loss, grads

    def train(self, pages: list[tuple], paths: Paths, epochs: int = EPOCHS) -> None:
        """Adam over batches of pages of like length; each page is (vectors, paths, labels, weights)."""
        rng = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][2]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        step, steps = 0, epochs * len(batches)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                chosen = [pages[i] for i in batches[k]]
                x, mask = padded([p[0] for p in chosen])
                numbers, where = np.unique(np.concatenate([p[1] for p in chosen]), return_inverse=True)
                places = np.zeros((len(numbers), PATH), dtype=np.float32)
                for row, number in enumerate(numbers.tolist()):
                    places[row, paths.places(number)] = 1
                rows = np.zeros(mask.shape, dtype=np.int64)
                target, weight = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
                inside = mask > 0
                rows[inside] = where
                target[inside] = np.concatenate([p[2] for p in chosen])
                weight[inside] = np.concatenate([p[3] for p in chosen])
                # Now and then a block goes without its path, so that its neighbours have to tell.
                seen = (rng.random(mask.shape) > 0.05).astype(np.float32)
                step += 1
                # The rate falls towards the end, which settles the weights whatever the last batches are.
                rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
                for name, grad in self.gradients(x, places, rows, mask, target, weight, seen)[1].items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad**2
                    change = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - rate * change).astype(np.float32)


class Reader:
    """Applies a labeller to pages; remembers paths and what they add to the gates."""

    def __init__(self, labeller: Labeller):
        self.labeller = labeller
        self._forget()

    def _forget(self) -> None:
        self.paths = Paths()
        self.gates = np.zeros((1024, 2, 4 * HIDDEN), dtype=np.float32)
        #: the same of a leaf, which also has its own tag
        self.leaves = np.zeros_like(self.gates)
        self.known = 1

    def _add(self) -> None:
        """Work out what paths add that have come up since."""
        w, paths = self.labeller.weights, self.paths
        while len(self.gates) < len(paths.parent):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            self.leaves = np.concatenate([self.leaves, np.zeros_like(self.leaves)])
        for path in range(self.known, len(paths.parent)):
            own, leaf = list(paths.added[path]), paths.leaf(path)
            for side in (0, 1):
                self.gates[path, side] = self.gates[paths.parent[path], side] + w[f"p{side}"][own].sum(axis=0)
                self.leaves[path, side] = self.gates[path, side] + (0 if leaf is None else w[f"p{side}"][leaf])
        self.known = len(paths.parent)

    def scores(self, pages: list[list]) -> np.ndarray:
        """The score of each block of some pages, padded to the longest; above 0 is main text."""
        w, n = self.labeller.weights, len(pages)
        self._add()
        x, mask = padded([features(page, self.paths) for page in pages])
        numbers = np.zeros(mask.shape, dtype=np.int64)
        numbers[mask > 0] = [path for page in pages for path, _, _ in page]
        out = np.full(mask.shape, w["bias"][0], dtype=np.float32)
        starts = range(0, mask.shape[1], STRETCH)
        for side in (0, 1):
            h = c = np.zeros((n, HIDDEN), dtype=np.float32)
            for low in starts if side == 0 else reversed(starts):
                part = slice(low, low + STRETCH)
                gates = x[:, part] @ w[f"x{side}"] + w[f"b{side}"] + self.leaves[numbers[:, part], side]
                states, _, h, c = self.labeller._run(gates, mask[:, part], side, h, c)
                out[:, part] += states @ w["out"][side * HIDDEN : (side + 1) * HIDDEN]
        return out

    def main_texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page."""
        if self.known > REMEMBERED:
            self._forget()
        found = [blocks(html, self.paths) for html in pages]
        out = [""] * len(pages)
        order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
        at = 0
        while at < len(order):
            # Pages of like length together; the longest of a group pads the others.
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(found[order[end]]) <= BATCH_BLOCKS:
                end += 1
            chosen = order[at:end]
            scores = self.scores([found[i] for i in chosen])
            for row, i in enumerate(chosen):
                out[i] = "\n".join(text for (_, text, _), score in zip(found[i], scores[row]) if score > 0)
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, WORDS + SIZES), dtype=np.float32)
    mask = np.zeros((len(pages), steps), dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


def composed(rng: np.random.Generator, texts: list[str], paths: Paths) -> tuple[list, np.ndarray]:
    """A page made of usual containers, filled with texts of the sample."""

    def number(path: list[tuple]) -> int:
        at = 0
        for tag, names in path:
            at = paths.child(at, tag, names)
        return at

    def text(long: bool) -> str:
        words = texts[rng.integers(len(texts))].split()
        return " ".join(words if long else words[: rng.integers(1, 12)])

    def named(words: str) -> tuple:
        return (words.replace(" ", "-"),) if rng.random() < 0.8 else (words.title().replace(" ", ""),)

    def container(content: bool) -> list[tuple]:
        if rng.random() < 0.5:
            tags = sorted(CONTENT_TAGS if content else OTHER_TAGS)
            return [(tags[rng.integers(len(tags))], ())]
        words = CONTENT_WORDS if content else OTHER_WORDS
        tag = ("div", "section", "ul" if not content else "div")[rng.integers(3)]
        return [(tag, named(words[rng.integers(len(words))]))]

    page, labels = [], []

    def fill(base: list[tuple], content: bool, n: int) -> None:
        for _ in range(n):
            leaf = ("p", "p", "p", "h1", "h2", "h3", "li", "blockquote", "td", "pre", "div")[rng.integers(11)]
            own = base if leaf == "div" and rng.random() < 0.5 else [*base, (leaf, ())]
            if leaf == "li":
                own = [*base, ("ul", ()), (leaf, ())]
            body = text(rng.random() < (0.8 if content else 0.4))
            links = rng.random()
            linked = len(body) if not content and links < 0.5 else int(links * 0.2 * len(body))
            page.append((number(own), body, linked))
            labels.append(float(content))

    body = [("body", ())]
    if rng.random() < 0.5:
        body.append(("div", (("wrapper", "page", "container", "site", "root")[rng.integers(5)],)))
    for _ in range(rng.integers(1, 4)):
        fill([*body, *container(False)], False, rng.integers(1, 6))
    # Some pages put their text straight into the body.
    inside = [*body, *(container(True) if rng.random() < 0.8 else [])]
    if rng.random() < 0.4:
        inside += container(True)
    for _ in range(rng.integers(1, 4)):
        fill(inside, True, rng.integers(1, 8))
        if rng.random() < 0.5:
            fill([*inside, *container(False)], False, rng.integers(1, 3))
    fill(inside, True, 1)
    for _ in range(rng.integers(1, 4)):
        fill([*body, *container(False)], False, rng.integers(1, 6))
    return page, np.array(labels, dtype=np.float32)


def fit(htmls: list[str]) -> Labeller:
    """Train on some pages and on the pages composed from their texts."""
    paths, examples, texts = Paths(), [], []

    def example(page: list, labels: list) -> None:
        numbers = np.array([path for path, _, _ in page])
        known = np.array([x is not None for x in labels], dtype=np.float32)
        examples.append((features(page, paths), numbers, np.array([x or 0.0 for x in labels], dtype=np.float32), known))

    for html in htmls:
        page = blocks(html, paths)
        if page:
            example(page, [paths.label[path] for path, _, _ in page])
            texts += [text for _, text, _ in page]
    rng = np.random.default_rng(3)
    for _ in range(COMPOSED):
        example(*composed(rng, texts or ["word"], paths))
    labeller = Labeller()
    labeller.train(examples, paths)
    return labeller


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Train on at most ``sample`` pages of at most SAMPLE_CHARS characters."""
    known = pages.filter(F.length("html") <= SAMPLE_CHARS).select("page_id", F.xxhash64("html").alias("mark"), "html")
    order = [F.xxhash64("page_id"), "page_id", "mark"]
    # Only ids travel to pick the sample: at most `sample` rows of two numbers.
    chosen = known.select("page_id", "mark").distinct().orderBy(*order).limit(sample)
    rows = known.join(F.broadcast(chosen), ["page_id", "mark"], "left_semi").dropDuplicates(["page_id", "mark"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = fit([html for batch in batches for html in batch.column("html").to_pylist()]).weights
        arrays = [
            pa.array(list(weights), pa.string()),
            pa.array([list(w.shape) for w in weights.values()], pa.list_(pa.int32())),
            pa.array([w.tobytes() for w in weights.values()], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["name", "shape", "data"])

    # One task sees the bounded sample; only the weights come to the driver.
    learned = rows.repartition(1).sortWithinPartitions(*order).select("html").mapInArrow(learn, "name string, shape array<int>, data binary")
    found = {r.name: np.frombuffer(bytes(r.data), np.float32).reshape(r.shape) for r in learned.collect()}
    labeller = Labeller() if found else fit([])
    labeller.weights.update(found)
    return labeller


def html_extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """The columns of ``pages`` except ``html``, then ``text`` and ``n_chars`` of the main text."""
    shared = shipped(pages.sparkSession, labeller)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared())
        for batch in batches:
            texts = []
            column = batch.column("html")
            for low in range(0, len(column), 256):
                texts += reader.main_texts(column.slice(low, 256).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["row", "text", "n_chars"],
            )

    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(boxed(others).alias("row"), "html")
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(extract, f"row {kind}, text string, n_chars long")
    return done.select(*unboxed("row", others), "text", "n_chars")
