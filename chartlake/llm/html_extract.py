"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block tags). Every block has a vector of its tag path
(tags, class and id words of its ancestors, hashed), of its words (hashed) and of a few measures. A bidirectional
LSTM in numpy reads the blocks of a page in order and labels each with the whole page as context; the blocks
labelled as main text are joined.

There are no labelled pages, so the network is trained on laid-out pages made from the words of a bounded sample of
the given pages (see ``layout``), where the part that each block plays is known, and on those pages of the sample whose
tags tell it (see ``told_by_tags``).
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import slices, utf8_parts, word_hashes, word_spans

#: Pages whose words the training layouts use at most: those with the least hash of the id.
SAMPLE = 200
#: Pages longer than this are not in the sample.
SAMPLE_CHARS = 20_000
LAYOUTS, EPOCHS, HIDDEN = 1000, 20, 24
#: Steps times pages that are labelled at a time.
CELLS = 16_384
#: Steps whose inputs are multiplied at a time.
CHUNK = 4096
PATH_DIM, WORD_DIM, MEASURES = 40, 8, 8
INPUT = PATH_DIM + WORD_DIM + MEASURES

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"(?:class|id|role|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg".split())
_INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img nobr object").split())
#: Formulas: their elements are inline; a space keeps the parts apart.
_MATH = frozenset((
    "math semantics mrow mi mo mn ms mtext mspace msub msup msubsup munder mover munderover mmultiscripts mprescripts none mfrac msqrt mroot "
    "mstyle merror mpadded mphantom menclose maction mtable mtr mtd mlabeledtr annotation annotation-xml").split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
           "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_KEEPS_P = _INLINE | _VOID | {"li", "dt", "dd", "tr", "td", "th", "option", "button", "select"}


def blocks_of(page: str) -> list[tuple[str, str, int]]:
    """(tag path, text, characters in links) of the leaf blocks of a page, text decoded and white space made one space.

    Contents of scripts, styles, drawings and the like are no blocks; ends of tags that were never opened are ignored.
    Formulas and what stands in for an object are text of the block that they are in.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []
    paths = [""]
    text: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)

    def end_block() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((paths[-1], joined, linked))
            text.clear()
        linked = 0

    def add(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            piece = page[a:b]
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(at, n)
            break
        add(at, m.start())
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in _MATH:
            text.append(" ")
            continue
        if m.group(1):
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in _INLINE:
                continue
            end_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:], paths[k + 1:]
                    break
            continue
        if name == "svg" and m.group(3).endswith("/"):
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            if close is None and name == "svg":  # never closed: what follows is not part of the drawing
                continue
            at = close.end() if close else n
            continue
        if name == "a":
            in_link += 1
        if name in _INLINE:
            continue
        end_block()
        if name in _VOID:
            continue
        gone = _CLOSES.get(name) or (() if name in _KEEPS_P else {"p"})
        while stack and stack[-1][0] in gone:
            stack.pop()
            paths.pop()
        words = " ".join(sorted({w for a in _ATTR.findall(m.group(3)) for w in re.findall(r"[a-z]+", (a[0] + a[1]).lower())})) if m.group(3) else ""
        stack.append((name, words))
        paths.append(f"{paths[-1]}/{name}" + (f"[{words}]" if words else ""))
        in_link = 0
    end_block()
    return out


def _token_vector(token: str, dim: int) -> np.ndarray:
    return np.random.RandomState(zlib.crc32(token.encode())).standard_normal(dim)


class PathVectors:
    """Vectors of tag paths: the sum of the vectors of their tags, attribute words and word beginnings."""

    def __init__(self):
        self.known: dict[str, np.ndarray] = {}

    def of(self, path: str) -> np.ndarray:
        if path not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            tokens: set[str] = set()
            parts = [p for p in path.split("/") if p]
            for p in parts:
                tag, _, words = p.partition("[")
                tokens.add(tag)
                for w in words.rstrip("]").split():
                    tokens |= {f".{w}", f"~{w[:4]}"}
            if parts:
                tokens.add("last " + parts[-1].partition("[")[0])
            tokens -= {"html", "body"}
            self.known[path] = sum((_token_vector(t, PATH_DIM) for t in sorted(tokens)), np.zeros(PATH_DIM)) / 3.0
        return self.known[path]


_WORD_TABLE = np.random.RandomState(5).standard_normal((1024, WORD_DIM))


def features(pages: list[list[tuple[str, str, int]]], vectors: PathVectors) -> np.ndarray:
    """One row for each block of the pages, in order."""
    flat = [b for p in pages for b in p]
    if not flat:
        return np.zeros((0, INPUT))
    path = np.stack([vectors.of(b[0]) for b in flat])
    raw, off = utf8_parts(pa.array([b[1] for b in flat], pa.large_string()))
    starts, ends, first = word_spans(raw, off)
    slot = (word_hashes(raw, starts, ends, fold_case=True) & np.uint64(1023)).astype(np.int64)
    n_words = np.diff(first)
    words = np.zeros((len(flat), WORD_DIM))
    has = np.flatnonzero(n_words > 0)
    for d in range(WORD_DIM):
        words[has, d] = np.add.reduceat(_WORD_TABLE[slot, d], first[has]) if len(has) else 0
    words /= np.maximum(n_words, 1)[:, None]
    size = np.array([len(b[1]) for b in flat], float)
    link = np.array([b[2] for b in flat], float)
    stops = np.array([b[1].count(".") + b[1].count(",") for b in flat], float)
    count = np.array([len(p) for p in pages])
    place = np.concatenate([np.arange(c) / max(1, c) for c in count if c])
    total = np.repeat(np.array([sum(len(b[1]) for b in p) for p in pages], float), count)
    extra = np.stack([np.log1p(size) / 5, np.minimum(1, link / size), stops / np.maximum(1, n_words), place,
                      size / np.maximum(1, total), (size > 80).astype(float), np.ones(len(flat)),
                      np.array([b[1][:1] == "©" for b in flat], float)], axis=1)
    return np.concatenate([path, words, extra], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, w: dict, keep: list | None = None) -> np.ndarray:
    """One direction over (steps, pages, inputs); ``keep`` gets what the gradient needs."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out = np.empty((steps, pages, HIDDEN))
    for t in range(steps):
        if t % CHUNK == 0:  # the inputs' part of so many steps at a time; the state goes on
            pre = x[t:t + CHUNK] @ w["x"] + w["b"]
        z = pre[t % CHUNK] + h @ w["h"]
        g = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
        u = np.tanh(z[:, 3 * HIDDEN:])
        before, h0 = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep is not None:
            keep.append((i, f, o, u, before, tc, h0))
    return out


def _back(x: np.ndarray, w: dict, kept: list, d_out: np.ndarray) -> dict:
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, u, before, tc, h0 = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        grad["x"] += x[t].T @ dz
        grad["h"] += h0.T @ dz
        grad["b"] += dz.sum(0)
        dh, dc = dz @ w["h"].T, dc * f
    return grad


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, inputs), the order that turns each page round, and which steps are real."""
    size = np.array([len(r) for r in rows])
    steps = int(size.max(initial=1))
    x = np.zeros((steps, len(rows), INPUT))
    for k, r in enumerate(rows):
        x[:len(r), k] = r
    t = np.arange(steps)[:, None]
    return x, np.where(t < size, size - 1 - t, t), t < size


class Labeller:
    """Bidirectional LSTM with one logistic output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.RandomState(seed)
        self.w = {}
        for side in ("f", "b"):
            self.w[side] = {"x": rng.standard_normal((INPUT, 4 * HIDDEN)) * 0.15, "h": rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15,
                            "b": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
        self.w["o"] = {"w": rng.standard_normal(2 * HIDDEN) * 0.2, "b": np.zeros(1)}

    def scores(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        x, turn, _ = _padded(rows)
        page = np.arange(len(rows))[None, :]
        h = np.concatenate([_run(x, self.w["f"]), _run(x[turn, page], self.w["b"])[turn, page]], axis=2)
        p = _sigmoid(h @ self.w["o"]["w"] + self.w["o"]["b"][0])
        return [p[:len(r), k] for k, r in enumerate(rows)]

    def step(self, rows: list[np.ndarray], y: list[np.ndarray]) -> dict:
        x, turn, real = _padded(rows)
        page = np.arange(len(rows))[None, :]
        kf, kb = [], []
        back = x[turn, page]
        h = np.concatenate([_run(x, self.w["f"], kf), _run(back, self.w["b"], kb)[turn, page]], axis=2)
        goal = np.zeros(real.shape)
        for k, v in enumerate(y):
            goal[:len(v), k] = v
        e = np.where(real, _sigmoid(h @ self.w["o"]["w"] + self.w["o"]["b"][0]) - goal, 0.0) / max(1, real.sum())
        dh = e[:, :, None] * self.w["o"]["w"]
        return {"f": _back(x, self.w["f"], kf, dh[:, :, :HIDDEN]), "b": _back(back, self.w["b"], kb, dh[:, :, HIDDEN:][turn, page]),
                "o": {"w": np.einsum("tb,tbh->h", e, h), "b": np.array([e.sum()])}}


#: Names that layouts give to the parts around the main text, and to the main text.
_AROUND = {
    "menu": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "tabs"),
    "header": ("header", "masthead", "top", "site-header", "branding", "logo", "topbar"),
    "footer": ("footer", "foot", "site-footer", "copyright", "bottom", "legal"),
    "sidebar": ("sidebar", "side", "aside", "widget", "related", "recommended", "more-stories", "popular", "tags"),
    "notice": ("cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "banner", "overlay", "message"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "commercial"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "contact-form"),
    "comments": ("comments", "comment", "comment-list", "reader-comments", "discussion", "replies", "responses", "disqus"),
    "share": ("share", "social", "sharing", "follow", "buttons"),
}
_OWN_TAG = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
_MAIN = ("content", "post", "entry", "story", "article", "article-body", "post-content", "entry-content", "main", "main-content", "text", "body-text")


def layout(rng: np.random.RandomState, words: list[str]) -> tuple[str, list[int]]:
    """A made page and the label of each of its blocks in order (1: main text)."""
    page, labels = [], []

    def say(low: int, high: int) -> str:
        got = [words[k] for k in rng.randint(0, len(words), rng.randint(low, high + 1))]
        return html.escape(" ".join(got).capitalize() + ("." if rng.rand() < 0.8 else ""), quote=False)

    def block(tag: str, label: int, low: int, high: int, link: float = 0.0, before: str = "") -> None:
        inner = f'<a href="/x">{say(low, high)}</a>' if rng.rand() < link else say(low, high)
        if tag == "p" and rng.rand() < 0.1:
            inner = "<b>" + inner
        page.append(f"<{tag}>{before}{inner}" + ("" if tag in ("p", "li") and rng.rand() < 0.2 else f"</{tag}>"))
        labels.append(label)

    def attr(names) -> str:
        return f' {"class" if rng.rand() < 0.7 else "id"}="{names[rng.randint(len(names))]}"'

    def around(kind: str) -> None:
        own = _OWN_TAG.get(kind)
        plain = own is not None and rng.rand() < 0.5
        tag = own if plain else ("div", "section", "div")[rng.randint(3)]
        page.append(f"<{tag}{'' if plain and rng.rand() < 0.6 else attr(_AROUND[kind])}>")
        n = rng.randint(1, 7)
        if kind in ("menu", "share") or (kind in ("header", "footer", "sidebar") and rng.rand() < 0.4):
            listed = rng.rand() < 0.7
            page.append("<ul>" if listed else "")
            for _ in range(n):
                block("li" if listed else "div", 0, 1, 4, link=0.9)
            page.append("</ul>" if listed else "")
        elif kind == "comments":
            for _ in range(n):
                wrap = rng.rand() < 0.5
                page.append('<div class="comment">' if wrap else "")
                block(("p", "div", "p")[rng.randint(3)], 0, 2, 40)
                page.append("</div>" if wrap else "")
        elif kind in ("advert", "notice", "footer") and rng.rand() < 0.6:
            page.append(say(2, 14) if kind != "footer" else "&copy; " + say(2, 14))
            labels.append(0)
        else:
            for _ in range(min(n, 3)):
                block(("p", "div", "h3", "button" if kind == "form" else "p")[rng.randint(4)], 0, 1, 16, link=0.3)
        page.append(f"</{tag}>")

    def some(kinds: tuple[str, ...], chance: float) -> None:
        for k in kinds:
            if rng.rand() < chance:
                around(k)

    some(("menu", "header", "notice", "advert", "menu", "form"), 0.4)
    shape = rng.randint(5)
    tag = ("article", "main", "div", "article", "section")[shape]
    page.append(f"<{tag}{attr(_MAIN) if shape in (2, 4) or rng.rand() < 0.2 else ''}>")
    if rng.rand() < 0.8:
        headed = rng.rand() < 0.15
        page.append("<header>" if headed else "")
        block("h1", 1, 1, 10)
        page.append("</header>" if headed else "")
    for _ in range(rng.randint(1, 12)):
        kind = rng.rand()
        if kind < 0.75:
            block("p", 1, 1, 60, link=0.05)
        elif kind < 0.85:
            block(("h2", "h3", "blockquote", "pre")[rng.randint(4)], 1, 1, 20)
        elif kind < 0.93:
            page.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                block("li", 1, 1, 20, link=0.1)
            page.append("</ul>")
        else:
            around(("advert", "sidebar", "share", "form", "notice", "menu")[rng.randint(6)])
    inside = rng.rand() < 0.3
    if inside:
        some(("share", "comments", "sidebar"), 0.4)
    page.append(f"</{tag}>")
    some(("comments", "sidebar", "advert", "share", "form", "notice", "footer", "footer"), 0.4)
    return "<html><body>" + "".join(page) + "</body></html>", labels


_AROUND_WORDS = frozenset(w for names in _AROUND.values() for n in names for w in n.split("-")) - {"more", "site", "list", "top", "side", "message"}


def told_by_tags(page: list[tuple[str, str, int]]) -> list[int] | None:
    """Labels of a page's blocks where its tags tell them: main inside ``article`` or ``main`` but for parts named as in
    layouts, else around it. None for pages without such a tag."""
    out, told = [], False
    for path, _, _ in page:
        parts = [p.partition("[")[::2] for p in path.split("/") if p]
        inside = [k for k, (tag, _) in enumerate(parts) if tag in ("article", "main")]
        told = told or bool(inside)
        names = {w for _, words in parts for w in words.rstrip("]").split()}
        tags = {tag for tag, _ in parts[inside[0]:]} if inside else set()
        out.append(int(bool(inside) and not names & _AROUND_WORDS and not tags & {"nav", "footer", "aside", "form"}))
    return out if told else None


def train(words: list[str], sample: list[list[tuple[str, str, int]]] = ()) -> Labeller:
    """Fit the labeller to laid-out pages of the given words and to the sample's pages whose tags tell their labels;
    the same input gives the same weights."""
    rng, net, vectors = np.random.RandomState(17), Labeller(), PathVectors()
    words = words or ["word"]
    rows, goal = [], []
    for page in sample:
        if page and (labels := told_by_tags(page)):
            rows.append(features([page], vectors))
            goal.append(np.array(labels, float))
    most = len(rows) + LAYOUTS
    while len(rows) < most:
        page, labels = layout(rng, words)
        got = blocks_of(page)
        if len(got) == len(labels):
            rows.append(features([got], vectors))
            goal.append(np.array(labels, float))
    first = {a: {b: np.zeros_like(v) for b, v in part.items()} for a, part in net.w.items()}
    second = {a: {b: np.zeros_like(v) for b, v in part.items()} for a, part in net.w.items()}
    order, t = np.arange(len(rows)), 0
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        for k in range(0, len(order), 35):
            grad = net.step([rows[j] for j in order[k:k + 35]], [goal[j] for j in order[k:k + 35]])
            t += 1
            for a, part in net.w.items():
                for b in part:
                    first[a][b] = 0.9 * first[a][b] + 0.1 * grad[a][b]
                    second[a][b] = 0.99 * second[a][b] + 0.01 * grad[a][b] ** 2
                    part[b] -= rate * (first[a][b] / (1 - 0.9**t)) / (np.sqrt(second[a][b] / (1 - 0.99**t)) + 1e-8)
    return net


def label_pages(net: Labeller, pages: list[list], vectors: PathVectors) -> list[np.ndarray]:
    """For each page a mask of its main blocks; pages of like length run together, ``CELLS`` steps of pages at most (a page
    of more runs alone), so that a long page is not padded to by many short ones."""
    rows = features(pages, vectors)
    cut = np.cumsum([0] + [len(p) for p in pages])
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = [k for k in np.argsort(np.diff(cut), kind="stable") if len(pages[k])]
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 128 and len(pages[order[b]]) * (b - a + 1) <= CELLS:
            b += 1
        part, a = order[a:b], b
        for k, s in zip(part, net.scores([rows[cut[k]:cut[k + 1]] for k in part]), strict=True):
            out[k] = s >= 0.5
    return out


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages, and pages without main text, have an empty text. Whole pages of any length are read; rows
    alike give rows alike; an empty table gives an empty result; other columns are not read.
    """
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    sample = src.filter(F.length("html") <= SAMPLE_CHARS).orderBy(F.xxhash64("page_id"), "page_id", "url").limit(SAMPLE).select("html").toArrow()
    seen = [blocks_of(p or "") for p in sample.column("html").to_pylist()]
    words = sorted({w for page in seen for b in page for w in b[1].split()[:200]})
    net = train(words[:: max(1, len(words) // 4000)], seen)
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = PathVectors()
        for b in slices(batches, "html", 1 << 20):
            got = [blocks_of(p or "") for p in b.column("html").to_pylist()]
            marks = label_pages(net, got, vectors)
            text = [" ".join([x[1] for x, keep in zip(p, m, strict=True) if keep]) for p, m in zip(got, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
