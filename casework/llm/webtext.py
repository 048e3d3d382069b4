"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score above zero, tags at most zero, and one linear scan finds the contiguous run
with the largest sum, which is where text is dense. Weights come from labelled pages: pages that mark their own article label
themselves (``labelled``), others can be given with offsets. They are learned so that the scan returns the labelled run: where it
does not, tokens it missed gain and tokens it took wrongly lose (``learn``). A word's weight depends on where it stands (plain,
marked content, link, page furniture), a tag's on its name and on what its class, id and role say. The run is widened to
the marked article that holds most of it, or else to whole blocks; furniture inside it (navigation, notices, adverts, forms,
reader comments) is left out.

Defined cases: null and empty pages, and pages without words, give an empty text; unclosed elements end where their parents or
the page do; comments, declarations and tags cut off by the page's end are no text; references that name nothing stay as they are;
repeated rows and equal pages give equal texts; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: element names of HTML and what they mean for text
OPAQUE = "script style title textarea noscript xmp iframe noembed noframes"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("aside audio button canvas datalist dialog footer form menu nav object search select svg template video".split())
CLOSES_ITS_LIKE = {"li": "ol ul menu dir", "dt": "dl", "dd": "dl", "td": "table", "th": "table", "tr": "table", "option": "select datalist"}
#: Parts of class names, ids and roles.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo "
    "cookie cookies disclaimer discussion disqus footer gdpr login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification notifications pager "
    "pagination paywall popup promo promos promoted promotion recommendations recommended related remark remarks replies reply respond responses search share sharing sidebar sidebars "
    "signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
HEADER_NAMES = frozenset(("header",))
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
MODIFIERS = frozenset("has is no page single type with without".split())
PAGE_ITSELF = frozenset("html body main".split())

ATTRIBUTES = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({OPAQUE.replace(' ', '|')})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({ATTRIBUTES})>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
TELLS = re.compile(r"class|id|role|hidden|itemprop|style", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

TAG, WORD = -3.25, 1.0  # before learning
LEAST_WORD, MOST_WORD, LEAST_TAG = 0.01, 3.0, -50.0
FIRST_WORDS = {"word": WORD, "word:content": WORD, "word:link": 0.25, "word:furniture": LEAST_WORD}
MARGINS = (0.25, 1.0, 4.0)
SAMPLE, LARGEST, EPOCHS = 256, 200_000, 8


@lru_cache(maxsize=4096)
def role_of(name: str, attributes: str) -> str:
    """What an element says about itself: "content", "furniture", "header" or nothing."""
    names: list[str] = []
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "furniture" if name not in PAGE_ITSELF else ""
        if key in ("class", "id", "role", "itemprop"):
            names += value.split()
    if name in PAGE_ITSELF:
        return "content" if name == "main" else ""
    whole = {n.lower().replace("-", "").replace("_", "") for n in names}
    parts = [[p.lower() for p in NAME_PARTS.findall(n)] for n in names]
    ends = {p[i] for p in parts if p and p[0] not in MODIFIERS for i in (0, -1)}
    if whole & CONTENT_NAMES and not whole & FURNITURE_NAMES:
        return "content"
    if ends & FURNITURE_NAMES:
        return "furniture"
    if name == "article":
        return "content"
    if name in FURNITURE:
        return "furniture"
    if name == "header" or ends & HEADER_NAMES:
        return "header"
    return "content" if {"articlebody", "entrycontent", "postcontent", "articlecontent", "maincontent", "postbody", "entrybody", "storybody"} & whole else ""


@dataclass
class Page:
    """Tokens of a page in order; a run of words between two tags is one token."""

    features: list[str] = field(default_factory=list)
    amounts: list[int] = field(default_factory=list)  # words, or 1 for a tag
    texts: list[str | None] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    shown: list[bool] = field(default_factory=list)  # false inside furniture
    headings: set[int] = field(default_factory=set)  # blocks
    content: list[tuple[bool, int, int]] = field(default_factory=list)  # (is an article, first token, last token)


def tokens(html: str) -> Page:
    """One pass over the page with a stack of open elements: (name, role, hidden before, links before, content before, first token)."""
    page, stack, open_ = Page(), [], Counter()
    block, at, hidden, links, inside = 0, 0, 0, 0, 0

    def add(feature: str, amount: int, text: str | None, start: int) -> None:
        page.features.append(feature)
        page.amounts.append(amount)
        page.texts.append(text)
        page.blocks.append(block)
        page.starts.append(start)
        page.shown.append(not hidden)

    def words(begin: int, end: int) -> None:
        text = html[begin:end]
        kind = "word:furniture" if hidden else "word:link" if links else "word:content" if inside else "word"
        add(kind, len(text.split()), text, begin)

    def pop() -> tuple[str, str]:
        nonlocal hidden, links, inside, block
        name, role, hidden, links, inside, first = stack.pop()
        open_[name] -= 1
        if role == "content" and not hidden:
            page.content.append((name == "article", first, len(page.features) - 1))
        block += name in BLOCKS
        return name, role

    def close(name: str) -> str:
        role = ""
        while stack:
            last, role = pop()
            if last == name:
                break
        return role

    for m in TOKEN.finditer(html):
        if m.start() > at:
            words(at, m.start())
        at = m.end()
        end, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if end:
            if name == "br":
                add("br", 1, " ", m.start())
            elif open_[name]:
                role = close(name)
                add(f"/{name}.{role}" if role else f"/{name}", 1, None, m.start())
            else:
                block += name in BLOCKS
                add(f"/{name}", 1, None, m.start())
            continue
        if name in BLOCKS:
            if open_["p"]:
                close("p")
            block += 1
        if name in HEADINGS:
            page.headings.add(block)
        if name in CLOSES_ITS_LIKE and open_[name]:
            barrier = CLOSES_ITS_LIKE[name].split()
            for other, *_ in reversed(stack):
                if other == name:
                    close(name)
                    break
                if other in barrier:
                    break
        role = role_of(name, attributes) if TELLS.search(attributes) else role_of(name, "")
        if role == "header":
            role = "" if inside else "furniture"
        add(f"{name}.{role}" if role else name, 1, " " if name == "br" else None, m.start())
        if name in VOID or (attributes.endswith("/") and name not in BLOCKS and name not in ("a", "b", "i", "span", "em", "strong")):
            continue
        stack.append((name, role, hidden, links, inside, len(page.features)))
        open_[name] += 1
        if role == "content":
            if name in ("article", "main") and hidden and not any(r == "furniture" and n != "form" for n, r, *_ in stack):
                hidden = 0  # a form around the whole page hides nothing
            inside += 1
        hidden += role == "furniture"
        links += name == "a"
    if at < len(html):
        words(at, len(html))
    while stack:
        pop()
    return page


def weight(feature: str, weights: dict[str, float]) -> float:
    """Learned weight, else that of the same role on any element, else what every tag or word starts with."""
    w = weights.get(feature)
    if w is None:
        if feature.startswith("word"):
            return FIRST_WORDS[feature]
        _, _, role = feature.partition(".")
        w = weights.get(f".{role}", TAG) if role else TAG
    return w


def best_run(features: Sequence[str], amounts: Sequence[int], weights: dict[str, float]) -> tuple[int, int] | None:
    """First and last token of the run with the largest sum (of several the first, and its shortest form); none without words."""
    known: dict[str, float] = {}
    best, found, total, begin = 0.0, None, 0.0, 0
    for i, (f, n) in enumerate(zip(features, amounts)):
        w = known.get(f)
        if w is None:
            w = known[f] = weight(f, weights)
        if total <= 0:
            total, begin = 0.0, i
        total += w * n
        if total > best:
            best, found = total, (begin, i)
    return found


def learn(pages: Sequence[tuple[Sequence[str], Sequence[int], int, int]], epochs: int = EPOCHS, step: float = 0.5) -> dict[str, float]:
    """Weights under which the best run of each (features, amounts, first, last) is the labelled one, as far as ``epochs`` passes get."""
    weights = dict(FIRST_WORDS)
    for _ in range(epochs):
        wrong = 0
        for features, amounts, first, last in pages:
            for scale in MARGINS:  # blocks shorter and longer than those seen are to come out right too
                trial = weights | {f: scale * w for f, w in weights.items() if f.startswith("word")}
                low, high = best_run(features, amounts, trial) or (0, -1)
                if (low, high) == (first, last):
                    continue
                wrong += 1
                change: Counter = Counter()
                for i in range(min(first, low), max(last, high) + 1):
                    change[features[i]] += ((first <= i <= last) - (low <= i <= high)) * min(amounts[i], 3)
                for f, c in change.items():
                    w = weight(f, weights) + step * max(-3, min(3, c))
                    if c:
                        weights[f] = min(MOST_WORD, max(LEAST_WORD, w)) if f.startswith("word") else min(0.0, max(LEAST_TAG, w))
        if not wrong:
            break
    furniture = [w for f, w in weights.items() if f.endswith(".furniture")]
    return weights | ({".furniture": min(TAG, sum(furniture) / len(furniture))} if furniture else {})


def content_span(page: Page, run: tuple[int, int]) -> tuple[int, int]:
    """The marked article that holds most words of the run, else other marked content that does, else the run's whole blocks and their heading."""
    low, high = run
    before = [0, *accumulate(n if s and t is not None and f != "br" else 0 for n, s, t, f in zip(page.amounts, page.shown, page.texts, page.features))]
    all_ = before[high + 1] - before[low]
    for article in (True, False):
        fits = [(before[min(high, e) + 1] - before[max(low, b)], (b - e) * (-1 if article else 1), b, e) for is_, b, e in page.content if is_ == article and max(low, b) <= min(high, e)]
        if fits and 2 * max(fits)[0] > all_:
            return max(fits)[2:]
    for i in range(low - 1, -1, -1):  # the rest of its first block, and headings right before it
        words = page.texts[i] is not None and page.texts[i].strip()
        if words and (page.blocks[i] == page.blocks[run[0]] or (page.shown[i] and page.blocks[i] in page.headings)):
            low = i
        elif words:
            break
    while high + 1 < len(page.blocks) and page.blocks[high + 1] == page.blocks[run[1]]:
        high += 1
    return low, high


def main_text(html: str | None, weights: dict[str, float]) -> str:
    page = tokens(html or "")
    run = best_run(page.features, page.amounts, weights)
    if run is None:
        return ""
    low, high = content_span(page, run)
    out: dict[int, list[str]] = {}
    for i in range(low, high + 1):
        if page.texts[i] is not None and page.shown[i]:
            out.setdefault(page.blocks[i], []).append(page.texts[i])
    blocks = (" ".join(unescape("".join(b)).split()) for b in out.values())
    return "\n\n".join(b for b in blocks if b)


def marked(html: str) -> tuple[int, int] | None:
    """Offsets of the first and behind the last word of a page's only article; none where that is not clear."""
    page = tokens(html)
    articles = [(b, e) for is_, b, e in page.content if is_]
    outer = [x for x in articles if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in articles)]
    if len(outer) != 1:
        return None
    own = [i for i in range(outer[0][0], outer[0][1] + 1) if page.amounts[i] and page.features[i].startswith("word") and page.shown[i]]
    return (page.starts[own[0]], page.starts[own[-1]] + len(page.texts[own[-1]])) if own else None


def labelled(pages: DataFrame, sample: int = SAMPLE, largest: int = LARGEST) -> DataFrame:
    """html, begin, end (offsets in code points) of pages that mark one article: ``sample`` pages of at most ``largest`` bytes, chosen by hash."""
    html = pages.select(F.col("html").cast("string").alias("html")).where((F.octet_length("html") <= largest) & F.contains(F.lower("html"), F.lit("<article")))
    some = html.orderBy(F.xxhash64("html")).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *span) for h in batch.column(0).to_pylist() if (span := marked(h))]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["html", "begin", "end"])

    return some.mapInArrow(run, "html string, begin bigint, end bigint")


def fit(labels: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from labelled pages (html, begin, end), of which at most ``sample`` are used; their tokens, not their texts, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html, begin, end in zip(*(batch.column(c).to_pylist() for c in ("html", "begin", "end")), strict=True):
                page = tokens(html)
                own = [i for i, (s, f, n) in enumerate(zip(page.starts, page.features, page.amounts)) if n and f.startswith("word") and begin <= s < end]
                if own:
                    rows.append((page.features, page.amounts, own[0], own[-1]))
            types = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["features", "amounts", "first", "last"])

    seen = labels.select("html", "begin", "end").limit(sample).mapInArrow(run, "features array<string>, amounts array<int>, first int, last int").collect()
    return learn(sorted(tuple(r) for r in seen))


def extract(pages: DataFrame, weights: dict[str, float], keep: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep``, text and n_chars of every page."""
    slim = pages.select(*keep, F.col(html).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(h.as_py(), weights) for h in part.column(part.num_columns - 1)]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, text string, n_chars bigint")
