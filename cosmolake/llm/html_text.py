"""Main text of web pages by consensus host paths.

First pass: each page's container elements are scored by the text that they
hold directly or in paragraphs, less what links and lists hold, and each
container is named by a generalised path of tags and classes (digits folded,
classes sorted; long paths keep a hash of their beginning). Vote: Spark sums
the scores of every path over a host's pages, whole numbers from each page,
and keeps the path with the largest sum. Second pass: every page is
extracted again from the elements on its host's winning path, widened to the
nearest article or main around them; a page without them falls back on its own
best container, widened likewise.

Scanning is one linear pass over tags. Scripts, styles, comments and markup
go; so do menus, headers, footers, asides, adverts, notices, forms and reader
comments, by tag, role or class. Outside an article any word of a class or id
may mark them; inside one only a class or id that says nothing else does
("ad", "comment-list", "share buttons", not "ad-hoc" or "related-work"), and
not the words that article parts go by as well. Character references are decoded, white
space within a block becomes one space, blocks are joined by one line feed.
Unclosed tags end with what contains them, and a page may stop anywhere.
Null and empty pages give an empty text; a page whose URL is null or has no
host votes under the host ''. Repeated rows vote repeatedly.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmolake.llm._shared import fresh, stored

LONG = 400  #: Of a path longer than this the beginning becomes a hash, so every element has a path of its own and all are short.
BROADCAST_HOSTS = 200_000  #: Winning paths are broadcast up to so many hosts.

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select option button canvas annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINER = frozenset("article body main section div td blockquote".split())
ENDS_P = BLOCK - frozenset("body html".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Tags and words that mark what isn't main text.
BOILER_TAGS = frozenset("nav footer aside form menu dialog head search".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead sidebar sidebars aside widget widgets related recommended recommendations share sharing social comment comments disqus discussion replies respond pagination pager toolbar skip print".split())
DOUBTFUL_WORDS = frozenset("print discussion skip banner replies respond notes related recommended menu menus".split())  # also words for parts of an article
FRAME_WORDS = frozenset("area bar block blocks body bottom box button buttons container content group header inline inner item items left links list main module outer panel posts right row section site slot thread title top unit wrap wrapper zone".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_VALUE = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*+"
_INSIDE = rf"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE}))?|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*){_INSIDE}(?:>|\Z)|<([a-zA-Z][^\s/>]*)({_INSIDE})(?:>|\Z)", re.S)
_ATTR = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*+)))?")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW_END: dict[str, re.Pattern[str]] = {}


@dataclass
class Element:
    tag: str
    path: str
    boiler: bool
    up: Element | None
    score: float = 0.0
    inside: bool = False  #: Whether it or an ancestor is boilerplate.
    article: bool = False  #: Whether it or an ancestor is an article.
    depth: int = 0
    box: Element | None = None  #: The nearest container, itself included.
    chosen: bool | None = None
    order: int = 0


@dataclass
class Block:
    owner: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _short(path: str) -> str:
    """A path, or a hash of its beginning and its end."""
    if len(path) <= LONG:
        return path
    cut = len(path) - LONG // 2
    return f"#{hashlib.blake2b(path[:cut].encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}{path[cut:]}"


def _named(tag: str, attrs: dict[str, str]) -> str:
    """A tag with its classes, generalised: sorted, digits folded."""
    cls = sorted({re.sub(r"\d+", "0", c) for c in attrs.get("class", "").lower().split()})
    return tag + "".join(f".{c}" for c in cls)


def _boiler(tag: str, attrs: dict[str, str], within_article: bool, in_line: bool = False) -> bool:
    if tag in BOILER_TAGS or tag == "header" and not within_article or attrs.get("role", "").lower() in BOILER_ROLES or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    names = [w for key in ("class", "id") for w in attrs.get(key, "").lower().split()]
    if not within_article and not in_line:
        return any(w in BOILER_WORDS for name in names for w in _WORD.findall(name))
    for name in names:
        said = [w for w in _WORD.findall(name) if w not in FRAME_WORDS]
        if said and all(w in BOILER_WORDS and w not in DOUBTFUL_WORDS for w in said):
            return True
    return False


def scan(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order and all container elements."""
    root = Element("", "", False, None)
    stack, blocks, containers = [root], [], []
    current: Block | None = None
    opened: Counter[str] = Counter()  # open elements by tag: none to look for, no walk up the stack
    links = at = count = 0

    def text(s: str) -> None:
        nonlocal current
        if current is None:
            if not s.strip():
                return
            current = Block(stack[-1])
            blocks.append(current)
        current.parts.append(s)
        if links:
            current.linked += len(s.strip())

    def close(depth: int) -> None:
        nonlocal current
        for e in stack[depth:]:
            opened[e.tag] -= 1
            if e.tag in BLOCK:
                current = None
        del stack[depth:]

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        end, start = m.group(1), m.group(2)
        if start:
            tag = start.lower()
            if tag in RAW:
                stop = _RAW_END.get(tag) or _RAW_END.setdefault(tag, re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I))
                if not m.group(3).rstrip().endswith("/"):
                    found = stop.search(page, at)
                    at = found.end() if found else n
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in ENDS_P:
                current = None
                for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
                for k in range(len(stack) - 1, 0, -1) if tag in SAME_ENDS and any(opened[x] > 0 for x in SAME_ENDS[tag]) else ():
                    if stack[k].tag in SAME_ENDS[tag]:
                        close(k)
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "div", "article", "section"):
                        break
            if tag in VOID:
                continue
            attrs = {}
            for k, a, b, c in _ATTR.findall(m.group(3)):
                attrs.setdefault(k.lower(), entities.unescape(a or b or c))  # the first of a name counts
            up = stack[-1]
            count += 1
            if tag in BLOCK:
                path = _short(f"{up.path}/{_named(tag, attrs)}")
                e = Element(tag, path, _boiler(tag, attrs, up.article), up, order=count)
            else:
                e = Element(tag, up.path, _boiler(tag, attrs, up.article, True), up, order=count)
            e.inside = up.inside or e.boiler
            e.article = up.article or tag in ("article", "main")
            e.depth = up.depth + 1
            e.box = e if tag in CONTAINER else up.box
            stack.append(e)
            opened[tag] += 1
            links += tag == "a"
            if tag in CONTAINER:
                containers.append(e)
        elif end:
            tag = end.lower()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    links -= sum(e.tag == "a" for e in stack[k:])
                    close(k)
                    break
                if stack[k].tag in CONTAINER and tag not in BLOCK:
                    break
            if tag in BLOCK:
                current = None
        links = max(0, links)
    return blocks, containers


def tidy(block: Block) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(block.parts))).strip()


def score(blocks: list[Block], containers: list[Element]) -> list[Element]:
    """Containers by score, best first: text without links, halved at each level above the block's own container."""
    for b in blocks:
        if b.owner.inside:
            continue
        size = sum(map(len, b.parts))
        worth = float(size - 2 * b.linked) * (0.3 if "/li" in b.owner.path else 1.0)
        e, share = b.owner.box, 1.0
        while e is not None and share > 0.05:
            e.score += worth * share * (1.5 if e.tag in ("article", "main") else 1.0)
            share /= 2
            e = e.up.box
    return sorted((c for c in containers if not c.inside and c.score > 0), key=lambda c: (-c.score, c.order))


def paths(page: str) -> list[tuple[str, float]]:
    """The page's votes: generalised paths of its containers, each path once, the best container's first."""
    out: dict[str, float] = {}
    for c in score(*scan(page)):
        out[c.path] = out.get(c.path, 0.0) + c.score
    return list(out.items())


def _under(e: Element | None, chosen: set[int]) -> bool:
    """Whether an element or one above it is chosen; every element is looked at once."""
    passed = []
    while e is not None and e.chosen is None and id(e) not in chosen:
        passed.append(e)
        e = e.up
    found = False if e is None else True if e.chosen is None else e.chosen
    for x in passed:
        x.chosen = found
    return found


def _lifted(e: Element) -> Element:
    """The nearest article or main around an element, itself included; without one, the element."""
    up: Element | None = e
    while up is not None and up.tag not in ("article", "main"):
        up = up.up
    return up or e


def extract(page: str, path: str | None) -> str:
    """Main text of the articles around the elements on ``path``, or around the page's own best container if there are none."""
    blocks, containers = scan(page)
    chosen = {id(_lifted(c)) for c in containers if c.path == path and not c.inside}
    if not chosen:
        best = score(blocks, containers)
        chosen = {id(_lifted(best[0]))} if best else None
    out = []
    for b in blocks:
        if b.owner.inside:
            continue
        if (chosen is None or _under(b.owner, chosen)) and (line := tidy(b)):
            out.append(line)
    return "\n".join(out)


def host(url: Column) -> Column:
    """Lower-cased host of a URL, without port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def votes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path): each host's winning path, ties to the smallest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str], int] = defaultdict(int)
            for h, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for path, s in paths(p.as_py() or ""):
                    total[h, path] += round(s)
            keys = list(total)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["host", "path", "score"])

    found = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("html")).where("html is not null").mapInArrow(task, "host string, path string, score long")
    sums = found.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("score"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the main text by the host's winning path; any other columns stay, whatever their names."""
    mine, theirs, won_path = fresh(pages, "host", "won", "path")
    won = stored(votes(pages, url, page).withColumnsRenamed({"host": theirs, "path": won_path}), "votes")
    if won.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        won = F.broadcast(won)  # then no page moves; beyond that, a join whose large partitions are split
    keyed = pages.withColumn(mine, host(F.col(url)))
    joined = keyed.join(won, F.col(mine) == F.col(theirs), "left")

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, path in batches:
            yield pa.array([extract(h.as_py() or "", p.as_py()) for h, p in zip(html, path, strict=True)], pa.string())

    return joined.withColumn(out, run(F.col(page), F.col(won_path))).drop(mine, theirs, won_path)
