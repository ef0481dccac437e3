"""Operator 8: main text of web pages by minimum-cut labelling.

Method.  A page is cut into blocks of text; a block ends where a block-level element begins or ends.  A logistic classifier over the
shape of a block's text (words, links, punctuation, kind of block) gives each block log odds of being content, within ``TEXT_ODDS`` either
way; to these come the fixed odds of the markup around it (``EVIDENCE``).  The sum is a block's cost for being content and for being
boilerplate.  Blocks are nodes, these costs the capacities to the two terminals; neighbouring blocks, and blocks of the same parent
element, are joined by smoothness edges.  A minimum cut, found by maximum flow, labels the blocks.

Blocks whose own cost outweighs all their smoothness edges have their label in every minimum cut; they are settled first
and passed to their neighbours' terminals, so that the flow runs over undecided blocks only.

The classifier is trained on a sample of about ``SAMPLE_PAGES`` different pages of any length, whose authors have marked them up: blocks of ``article``
and ``main`` elements are positive, those of navigation, footers, asides, forms, comments and adverts negative.  Labels come from markup and
features from text, which have nothing in common.  It is fitted by penalised logistic regression towards ``PRIOR``, so that
features which the sample lacks keep their prior weight.

Markup.  A name (class, id, role) tells of boilerplate only if all its parts do or say nothing: ``site-footer``, ``post-comments``, but not
``related-work`` or ``comments-open``.  Within an article, names that can also stand in one (``SOFT``) are outweighed by running text; those
of comments, adverts and consent (``VETO``) are not.

Text: character references decoded, white space within a block one space, trimmed; blocks in page order, joined by two line
feeds.

Edge cases.  Null or empty html, or a page without content: empty text, n_chars 0.  Unclosed, misnested and cut off markup is read as
far as it goes.  Pages of any size and depth are read in one pass.  Repeated rows give repeated results, an empty table an
empty one.  Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.shared import table

SAMPLE_PAGES = 500
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, or (annotations of formulas) says it a second time.
RAW = frozenset("script style template textarea title svg iframe canvas select annotation annotation-xml".split())
ENDS_P = BLOCK_TAGS - {"button", "option", "optgroup", "legend", "head", "html", "body"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words in names: of comments, adverts and consent; of other boilerplate; of what can also be part of an article; of layout, which say nothing.
VETO = frozenset(
    "ad ads adbox adsbygoogle adsense adslot adunit advert advertisement advertising adverts comment commentary commentlist comments consent cookie cookies disqus gdpr modal popup promo promoted "
    "replies respond sponsor sponsored sponsors".split()
)
BAD = frozenset(
    "banner breadcrumb breadcrumbs copyright footer header login masthead menu menus nav navbar navigation newsletter notice notices pager pagination share sharing sidebar signup skip social "
    "subscribe subscription toolbar widget widgets".split()
)
SOFT = frozenset("legal recommendations recommended related reply review reviews search tag tags".split())
LAYOUT = frozenset(
    "area article articles bar block body bottom box btn button buttons card column container content entry fixed form global group icon icons inner item items left line link links list main message "
    "mobile module outer page panel post posts primary reader right row secondary section side site slot stories story text thread title top unit user wrap wrapper".split()
)
GOOD = frozenset("article body content entry main post prose story text".split())
#: Names of page layouts, which say nothing about the element itself.
_SIDED = re.compile(r"\b(?:has|with|no|without|left|right)-?_?sidebars?\b", re.I)
_SPACE = re.compile(r"\s+")
FEATURES = ("bias", "link_share", "paragraph", "heading", "list", "cell", "words", "sentence")
#: Prior weights of the features, towards content.
PRIOR = np.array([-1.0, -3.0, 1.5, 1.0, -0.5, 0.0, 0.3, 0.5])
TEXT_ODDS = 3.0
_ART, _BOIL, _GOODN, _SOFTN, _BADN, _VETON, _HID = (1 << k for k in range(7))
#: Log odds that an element's markup adds for the blocks in it.
EVIDENCE = {_ART: 4.5, _BOIL: -9.0, _GOODN: 2.0, _SOFTN: -4.0, _BADN: -9.0, _VETON: -12.0, _HID: -12.0}
ADJACENT, SAME_PARENT = 0.25, 0.5


class Block:
    __slots__ = ("chars", "flags", "link_chars", "parent", "parts", "tag", "text")

    def __init__(self, tag: str, flags: int, parent: int):
        self.tag, self.flags, self.parent = tag, flags, parent
        self.parts: list[str] = []
        self.chars = self.link_chars = 0
        self.text = ""


def name_flags(names: str, in_article: bool) -> int:
    """What the names of an element say of it; a header of an article is its own."""
    flags = 0
    for name in _SIDED.sub(" ", names).split():
        parts = {x.lower() for x in _PARTS.findall(name)}
        if in_article:
            parts.discard("header")
        told = parts - LAYOUT
        if told and told <= VETO | BAD | SOFT:
            flags |= _VETON if told & VETO else _BADN if told & BAD else _SOFTN
        elif parts & GOOD:
            flags |= _GOODN
    return flags & ~_GOODN if flags & (_VETON | _BADN | _SOFTN) else flags


def _flags(tag: str, attrs: str, above: int, in_article: bool) -> int:
    flags = above
    if tag in ("article", "main"):
        flags |= _ART
    elif tag in ("nav", "footer", "aside", "form", "menu", "dialog", "button") or tag == "header" and not in_article:
        flags |= _BOIL
    elif tag == "noscript":
        flags |= _SOFTN
    if attrs:
        names = " ".join("".join(x) for x in _NAMES.findall(attrs))
        if names and tag not in ("html", "body", "main", "article"):
            flags |= name_flags(names, in_article)
        if _HIDDEN.search(attrs):
            flags |= _HID
    return flags


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, those without text left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, flags, element number
    open_count: dict[str, int] = {}
    serial, now, links = 0, None, 0

    def close():
        nonlocal now
        if now is not None:
            now.text = _SPACE.sub(" ", html_lib.unescape("".join(now.parts))).strip()
            if now.text:
                out.append(now)
            now = None

    def pop_to(tag: str):
        nonlocal links
        while True:
            t, _, _ = stack.pop()
            open_count[t] -= 1
            links -= t == "a"
            if t == tag:
                return

    def add(text: str):
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            block = next((x for x in reversed(stack) if x[0] in BLOCK_TAGS), stack[0]) if stack[-1][0] not in BLOCK_TAGS else stack[-1]
            now = Block(block[0], stack[-1][1], block[2])
        now.parts.append(text)
        size = len(text) - text.count(" ")
        now.chars += size
        if links:
            now.link_chars += size

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            if tag in BLOCK_TAGS:
                close()
            if open_count.get(tag):
                pop_to(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag in BLOCK_TAGS:
                close()
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
            if tag in ENDS_P and open_count.get("p"):
                pop_to("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and open_count.get(tag) and stack[-1][0] == tag:
                pop_to(tag)
        if tag not in VOID:
            serial += 1
            above = stack[-1][1]
            if not attrs.rstrip().endswith("/"):
                stack.append((tag, _flags(tag, attrs, above, bool(above & _ART)), serial))
                open_count[tag] = open_count.get(tag, 0) + 1
                links += tag == "a"
    close()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Of the text alone; shares in steps of 1/20 and words up to 40, so that there are some thousand different rows at most."""
    x = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        x[i] = (
            1.0, round(20 * b.link_chars / max(1, b.chars)) / 20, b.tag in ("p", "blockquote", "pre"), b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "dd", "dt"), b.tag in ("td", "th"),
            min(words, 40) / 10, b.text[-1] in ".!?:;\"'…”»",
        )
    return x


def odds(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds of content: those of the text, and the evidence of the markup."""
    marks = np.array([sum(v for k, v in EVIDENCE.items() if b.flags & k) for b in blocks])
    return np.clip(features(blocks) @ weights, -TEXT_ODDS, TEXT_ODDS) + marks


def marked(page: str) -> Counter:
    """(label, features) of the blocks whose label the markup tells, with their numbers."""
    blocks, out = blocks_of(page), Counter()
    for b, x in zip(blocks, features(blocks).tolist() if blocks else [], strict=True):
        bad = b.flags & (_BOIL | _BADN | _VETON | _HID)
        if bad or b.flags & _ART and not b.flags & _SOFTN:
            out[0 if bad else 1, tuple(x)] += 1
    return out


def train(counts: dict[tuple[int, tuple[float, ...]], int], rounds: int = 50, strength: float = 4.0) -> np.ndarray:
    """Weights by Newton steps of logistic regression with a Gaussian prior around PRIOR; counts of (label, features)."""
    w = PRIOR.copy()
    if not counts:
        return w
    x, y, n = np.array([f for _, f in counts]), np.array([label for label, _ in counts], float), np.array(list(counts.values()), float)
    n *= 2000 / max(2000, n.sum())  # the data weigh as 2,000 blocks at most
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + strength * (w - PRIOR)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + strength * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def max_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> list[bool]:
    """Dinic's algorithm over (u, v, capacity, capacity back).  Which nodes stay with s in a minimum cut."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for u, v, c, back in arcs:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)
    while True:
        level = [-1] * n
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level]
        turn = [0] * n
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if cap[e] == 0)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if cap[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(head[u]):
                path.append(head[u][turn[u]])
                u = to[path[-1]]
            elif not path:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1


def cut(cost: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content; cost: log odds of content; edges: (i, j, weight)."""
    n = len(cost)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    c = [round(1000 * float(x)) for x in cost]
    for i, j, w in edges:
        k = round(1000 * w)
        near[i].append((j, k))
        near[j].append((i, k))
    pull = [sum(k for _, k in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(c[i]) > pull[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = c[i] > 0
        for j, k in near[i]:
            if label[j] is None:
                c[j] += k if label[i] else -k
                pull[j] -= k
                if abs(c[j]) > pull[j]:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        arcs = [(s, place[i], c[i], 0) if c[i] > 0 else (place[i], t, -c[i], 0) for i in rest if c[i]]
        arcs += [(place[i], place[j], k, k) for i in rest for j, k in near[i] if j > i and label[j] is None]
        side = max_flow(len(rest) + 2, arcs, s, t)
        for i in rest:
            label[i] = side[place[i]]
    return [bool(x) for x in label]


def main_text(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    keep = cut(odds(blocks, weights), edges)
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def trained_weights(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from about `sample` different pages, those whose hash lies below a cut-off.

    Executors count the pages' labelled blocks by their features, of which there are some thousand different rows, so neither pages nor blocks
    come to the driver.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(html.alias("html")).where("html != ''").select("html", F.xxhash64("html").alias("h"))
    total = max(sample, pages.count())
    rows = rows.where(F.col("h") <= ((1 << 64) - 1) * sample // total - (1 << 63)).dropDuplicates(["h"])

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0):
                counts.update(marked(page.as_py()))
            if counts:
                yield pa.record_batch([pa.array([k for k, _ in counts], pa.int32()), pa.array([list(x) for _, x in counts], pa.list_(pa.float64())), pa.array(list(counts.values()), pa.int64())], ["label", "x", "n"])

    found = rows.select("html").mapInArrow(run, "label int, x array<double>, n long").groupBy("label", "x").agg(F.sum("n").alias("n")).collect()
    return train({(r["label"], tuple(r["x"])): r["n"] for r in sorted(found, key=lambda r: (r["label"], r["x"]))})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    w = trained_weights(pages, html_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "", w) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
