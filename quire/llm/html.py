"""Main text of web pages: a recurrent block labeller.

1. A page is cut at tags. Text between two block-level tags is a leaf; it carries the path of open elements with all words of their
   class, id and role, its words and the share of its characters inside links. Scripts, styles, comments, and what text fields and frames
   hold are no text. Drawings, formulas, objects, selects, templates and noscript are leaves with their name on the path.
2. Path names and words are hashed into vectors. A bidirectional LSTM (numpy) reads the whole sequence of leaves, so each leaf is
   judged with the page before and after it; pages of similar length run together.
3. Leaves labelled as main text are joined by line feeds.

The labeller is trained when it is needed, on made-up pages of many layouts whose labels are known (``Maker``), with a fixed seed;
its size and the number of those pages are parameters, so training costs the same for any input.

Inside a leaf character references are decoded and runs of white space become one space. A ``br`` is white space.

Defined results: null or empty html and pages without main text give an empty text; broken markup is read leniently (an unclosed
tag ends at the end of its parent, a drawing or formula also where a block of HTML begins; an unfinished tag at the end of the page is dropped); repeated rows are treated alike; extra
columns keep their names inside the struct ``row``. Memory follows the longest page (about 3 KB per leaf).
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textops

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 192, 32, 5
WIDTH = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
HIDDEN = 12

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea iframe".split())  # tags in them are no tags
FOREIGN = frozenset("svg math".split())  # elements in them are no HTML
EMBEDDED = FOREIGN | frozenset("noscript template object select".split())  # leaves of their own that may stand in a paragraph
# start tags that end a drawing or formula
BREAKOUT = frozenset(
    "article aside b big blockquote body br center code dd div dl dt em embed fieldset figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr i img li listing main menu meta nav nobr ol p pre ruby s section small span strong strike sub sup table tt u ul var".split()
)
CLOSES = {  # a start tag ends these open elements if they are the innermost block
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"},
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+(?:>|\Z)""", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[^\s_\-]+")


@dataclass
class Leaf:
    path: tuple[str, ...]
    text: str
    linked: float


def leaves(page: str) -> list[Leaf]:
    """Blocks of text in page order, with the names on their path from the outside in."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    begin = 0
    skip_to = 0
    endless: set[str] = set()

    def end_tag(name: str, at: int) -> re.Match[str] | None:
        if name in endless:
            return None
        found = re.compile(rf"</{re.escape(name)}(?:[\s/][^>]*)?>", re.I).search(page, at)
        if not found:
            endless.add(name)
        return found

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            path = tuple(name for tag, names in stack if tag not in INLINE for name in names)
            out.append(Leaf(path, text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text.strip())

    for token in _TOKEN.finditer(page):
        if token.start() < skip_to:
            continue
        add(page[max(begin, skip_to) : token.start()])
        begin = token.end()
        raw = token.group()
        if raw[1] in "!?":
            continue
        name = _NAME.match(raw)[1].lower()
        block = name not in INLINE
        if stack and stack[-1][0] in FOREIGN and name not in RAW:
            if raw[1] == "/":
                if not any(tag == name for tag, _ in stack):
                    continue
            elif name in BREAKOUT:
                close()
                stack.pop()
            elif name not in FOREIGN:
                parts.append(" ")
                continue
        if raw[1] == "/":
            if block:
                close()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            # an inline end tag doesn't reach out of its block
            if at >= 0 and (block or all(tag in INLINE for tag, _ in stack[at:])):
                del stack[at:]
            continue
        if name in RAW:
            if block:
                close()
            if not raw.endswith("/>"):
                end = end_tag(name, token.end())
                outer = (end_tag(tag, token.end()) for tag, _ in reversed(stack))
                parent = None if end else next((e for e in outer if e), None)
                begin = skip_to = end.end() if end else parent.start() if parent else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if block:
            close()
            while stack and stack[-1][0] in INLINE and name not in EMBEDDED:
                stack.pop()
            ends = () if name in EMBEDDED else CLOSES.get(name, {"p"})
            while stack and stack[-1][0] in ends:
                stack.pop()
        if name not in VOID and not raw.endswith("/>"):
            marks = [w for m in _MARKS.finditer(raw) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())]
            if len(marks) > PATH_BUCKETS:
                # one word a bucket, the last of it, is the same input to the labeller
                marks = list({_bucket(f".{w}"): w for w in marks}.values()) + marks[-1:]
            stack.append((name, (name, *(f".{w}" for w in marks))))
    if begin < len(page):
        rest = page[begin:]
        add(rest[: rest.find("<")] if re.match(r"[^<]*</?[a-zA-Z!?]", rest) else rest)
    close()
    return out


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_BUCKETS


def vectors(page: list[Leaf]) -> np.ndarray:
    """Input of the labeller: hashed path names, hashed words, and a few numbers per leaf."""
    out = np.zeros((len(page), WIDTH), dtype=np.float32)
    kinds: dict[tuple[str, ...], int] = {}
    kind = [kinds.setdefault(leaf.path, len(kinds)) for leaf in page]
    table = np.zeros((len(kinds), PATH_BUCKETS), dtype=np.float32)
    for path, i in kinds.items():
        table[i, [_bucket(n) for n in path] + [_bucket("last:" + n) for n in path[-1:]]] = 1
    out[:, :PATH_BUCKETS] = table[kind]
    raw = [leaf.text.lower().encode() for leaf in page]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts, ends, first = textops.words(data, at)
    counts = np.diff(first)
    if len(starts):
        bucket = (textops.word_codes(data, starts, ends) >> np.uint64(20)).astype(np.int64) % WORD_BUCKETS
        owner = np.repeat(np.arange(len(page)), counts)
        words = np.bincount(owner * WORD_BUCKETS + bucket, minlength=len(page) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
        out[:, PATH_BUCKETS:-NUMBERS] = words / np.maximum(np.sqrt((words**2).sum(axis=1, keepdims=True)), 1)
    out[:, -5] = np.log1p(np.diff(at)) / 6
    out[:, -4] = np.log1p(counts) / 5
    out[:, -3] = [leaf.linked for leaf in page]
    out[:, -2] = [leaf.text[-1:] in ".!?:;" for leaf in page]
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of both directions (input, state) and of the last layer."""

    inputs: list[np.ndarray]
    states: list[np.ndarray]
    last: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        inputs = [rng.normal(0, 0.15, (WIDTH, 4 * h)).astype(np.float32) for _ in range(2)]
        for w in inputs:
            w[-1, h : 2 * h] = 1  # memory is kept at first
        states = [rng.normal(0, 0.2, (h, 4 * h)).astype(np.float32) for _ in range(2)]
        return Labeller(inputs, states, rng.normal(0, 0.2, 2 * h + 1).astype(np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.last]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):  # type: ignore[no-untyped-def]
        """Scores for pages x leaves x inputs; ``mask`` has 1 for leaves that exist. Backwards, padding comes first and has no effect."""
        pages, steps, _ = x.shape
        h = HIDDEN
        both = np.zeros((pages, steps, 2 * h + 1), dtype=np.float32)
        both[:, :, -1] = 1
        trace: list[list[tuple]] = [[], []]
        for side in (0, 1):
            gates = x @ self.inputs[side]
            state = np.zeros((pages, h), dtype=np.float32)
            memory = np.zeros((pages, h), dtype=np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                z = gates[:, t] + state @ self.states[side]
                a = _sigmoid(z[:, : 3 * h])
                i, f, o = a[:, :h], a[:, h : 2 * h], a[:, 2 * h :]
                g = np.tanh(z[:, 3 * h :])
                m = mask[:, t : t + 1]
                new = (f * memory + i * g) * m
                bent = np.tanh(new)
                out = o * bent * m
                if keep:
                    trace[side].append((t, i, f, o, g, memory, bent, state, m))
                memory, state = new, out
                both[:, t, side * h : side * h + h] = out
        score = _sigmoid(both @ self.last)
        return (score, both, trace) if keep else score

    def slopes(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean logistic loss by backpropagation through both directions."""
        score, both, trace = self.run(x, mask, keep=True)
        h = HIDDEN
        error = ((score - label) * mask / mask.sum()).astype(np.float32)
        out = [np.zeros_like(p) for p in self.parameters()]
        out[4] = np.einsum("pt,pth->h", error, both)
        spread = error[:, :, None] * self.last
        for side in (0, 1):
            dz_all = np.zeros((*x.shape[:2], 4 * h), dtype=np.float32)
            d_state = np.zeros((len(x), h), dtype=np.float32)
            d_memory = np.zeros_like(d_state)
            for t, i, f, o, g, before, bent, state, m in reversed(trace[side]):
                d_out = (d_state + spread[:, t, side * h : side * h + h]) * m
                d_new = (d_out * o * (1 - bent**2) + d_memory) * m
                dz = np.concatenate(
                    [d_new * g * i * (1 - i), d_new * before * f * (1 - f), d_out * bent * o * (1 - o), d_new * i * (1 - g**2)], axis=1
                )
                dz_all[:, t] = dz
                out[2 + side] += state.T @ dz
                d_state, d_memory = dz @ self.states[side].T, d_new * f
            out[side] = np.einsum("pti,ptz->iz", x, dz_all, optimize=True)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, WIDTH), dtype=np.float32)
    mask = np.zeros((len(pages), steps), dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


class Maker:
    """Made-up pages of many layouts; main text is marked by a character that is taken out again."""

    MARK = ""
    MAIN = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'section class="article-body"',
            'div class="entry"', 'td class="story"', 'div role="main"')
    SIDE = {
        "nav": ("nav", 'ul class="menu"', 'div class="navbar"', 'div id="nav"', 'div class="breadcrumb"', 'div class="pagination"', 'div role="navigation"'),
        "head": ("header", 'div id="header"', 'div class="masthead"', 'div class="topbar"'),
        "foot": ("footer", 'div id="footer"', 'div class="copyright"', 'div class="site-footer"'),
        "side": ("aside", 'div class="sidebar"', 'div class="related"', 'div class="widget"', 'div class="share social"', 'div class="tags"'),
        "note": ('div class="cookie-notice"', 'div class="banner"', 'div class="notice"', 'div class="alert"', 'div class="newsletter"', 'div id="gdpr-consent"', 'div class="popup modal"'),
        "ad": ('div class="ad"', 'div class="advert"', 'div class="sponsored"', 'div class="promo"', 'div id="ads"', 'div class="advertisement"'),
        "form": ("form", 'form class="search"', 'form id="login"', "fieldset"),
        "talk": ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="reply"', 'div id="disqus"', 'div class="discussion"'),
    }

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        sounds = "an be the re ti on ou sch ung en al é que le de ño ción er st in or ä ü ro ka mi".split()
        self.vocabulary = ["".join(self.rng.choice(sounds, self.rng.integers(1, 5))) for _ in range(3000)]

    def words(self, least: int, most: int) -> str:
        text = " ".join(self.rng.choice(self.vocabulary, self.rng.integers(least, most + 1)))
        if self.rng.random() < 0.03:
            text = " ".join([text.split()[0]] * most)
        if self.rng.random() < 0.25:  # noise that may stand in any text
            text = text.replace(" ", self.rng.choice(["*** ", "&amp;&amp; ", " | ", "%%% ", "!! "]))
        return text[:1].upper() + text[1:] + self.rng.choice([".", "", "?", "."])

    def paragraph(self, mark: str) -> str:
        rng = self.rng
        text = mark + self.words(1, int(rng.choice([4, 30, 120])))
        if rng.random() < 0.15:
            text = f"<b>{text}</b>"
        if rng.random() < 0.1:
            text = f'{text} <a href="/x">{self.words(1, 4)}</a> {self.words(1, 20)}'
        shape = rng.random()
        if shape < 0.7:
            return f"<p>{text}</p>"
        if shape < 0.8:
            return f"<p>{text}<br>"
        if shape < 0.85:
            return f"<p><b>{text}<br>"
        if shape < 0.9:
            return f"<h2>{text}</h2>"
        if shape < 0.95:
            return f"<ul><li>{text}</li><li>{mark}{self.words(2, 9)}</li></ul>"
        return f"<blockquote>{text}</blockquote>"

    def aside(self, kind: str) -> str:
        rng = self.rng
        opening = str(rng.choice(self.SIDE[kind]))
        if kind in ("nav", "foot", "head") and rng.random() < 0.6:
            items = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(rng.integers(1, 9)))
            body = f"<ul>{items}</ul>"
        elif kind == "form":
            body = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>'
        elif kind == "talk":
            body = "".join(self.paragraph("") for _ in range(rng.integers(1, 6)))
        else:
            body = self.words(2, 40) if rng.random() < 0.6 else self.paragraph("") + (self.paragraph("") if rng.random() < 0.3 else "")
        return f"<{opening}>{body}</{opening.split()[0]}>"

    def page(self) -> tuple[list[Leaf], np.ndarray]:
        rng = self.rng
        pick = lambda kinds, p: "".join(self.aside(k) for k in kinds if rng.random() < p)
        body = [f"<h1>{self.MARK}{self.words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.integers(0, int(rng.choice([3, 12, 40])))):
            body.append(self.paragraph(self.MARK))
            if rng.random() < 0.05:
                body.append(self.aside(str(rng.choice(["ad", "side", "note", "form"]))))
        if rng.random() < 0.1:
            body.append(self.aside("talk"))
        main = str(rng.choice(self.MAIN)) if rng.random() < 0.7 else "article"
        inner = f"<{main}>{''.join(body)}</{main.split()[0]}>"
        if rng.random() < 0.3:
            inner = f'<div class="container wrapper">{inner}{pick(["side"], 0.5)}</div>'
        page = (
            f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>"
            + pick(["note", "head", "nav", "ad", "form"], 0.5) + inner + pick(["talk", "side", "ad", "note", "nav", "foot"], 0.45)
            + ("</body></html>" if rng.random() < 0.8 else "")
        )
        found = leaves(page)
        label = np.array([self.MARK in leaf.text for leaf in found], dtype=np.float32)
        return [Leaf(f.path, f.text.replace(self.MARK, "") or "-", f.linked) for f in found], label


def train(pages: int = 800, rounds: int = 8, seed: int = 11, rate: float = 0.02) -> Labeller:
    """Labeller fitted to made-up pages by Adam."""
    maker = Maker(seed)
    made = sorted((maker.page() for _ in range(pages)), key=lambda p: len(p[0]))
    made = [(vectors(p), y) for p, y in made if len(p)]
    model = Labeller.fresh(seed)
    parameters = model.parameters()
    mean, square = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    rng = np.random.default_rng(seed)
    batches = [made[i : i + 32] for i in range(0, len(made), 32)]
    step = 0
    for round_ in range(rounds):
        for b in rng.permutation(len(batches)):
            x, mask = padded([p for p, _ in batches[b]])
            label = padded_labels([y for _, y in batches[b]], x.shape[1])
            step += 1
            for k, slope in enumerate(model.slopes(x, mask, label)):
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.99 * square[k] + 0.01 * slope**2
                move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                parameters[k] -= rate * 0.7**round_ * move
    return model


def padded_labels(labels: list[np.ndarray], steps: int) -> np.ndarray:
    out = np.zeros((len(labels), steps), dtype=np.float32)
    for i, y in enumerate(labels):
        out[i, : len(y)] = y
    return out


def label_pages(model: Labeller, pages: list[list[Leaf]], cells: int = 4096) -> list[np.ndarray]:
    """Whether each leaf is main text. Pages of similar length are padded to one length, ``cells`` leaves at a time."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if pages[i]]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= cells:
            end += 1
        own = order[at:end]
        every = vectors([leaf for i in own for leaf in pages[i]])
        cuts = np.cumsum([len(pages[i]) for i in own])[:-1]
        score = model.run(*padded(np.split(every, cuts)))
        for row, i in enumerate(own):
            out[i] = score[row, : len(pages[i])] >= 0.5
        at = end
    return out


def extract(pages: DataFrame, model: Labeller, html: str = "html") -> DataFrame:
    """row (struct of all columns, the html being null), text: main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in textops.chunks(batches, "text"):
            found = [leaves(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(at[:-1], at[1:], strict=True)]
            marks = label_pages(model, found)
            texts = ["\n".join(leaf.text for leaf, m in zip(p, k, strict=True) if m) for p, k in zip(found, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    slim, kind = textops.without(pages, html)
    return pages.select(slim.alias("row"), F.col(html).alias("text")).mapInArrow(run, f"row {kind}, text string")
