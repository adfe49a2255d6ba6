"""Operator 3: main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags, and words of text. A token is told apart by its path of open elements, so the same
word in a menu and in an article is two tokens. Over the pages of one host, each token has an occurrence vector: how often
it stands on each page. Tokens with the same vector form an equivalence class. A class of some support is the template's
if it has a tag, so that each of a host's layouts has its own, or if it is on most pages of the host. On each page the classes
are nested: the tokens of a class stand in one order in every round of it, and a round lies within one gap of the round
around it; a class that crosses another is dropped. That makes a tree of rounds, and its gaps are the slots. What the template
doesn't hold fills the slots.

Which slots are content: elements have roles by name (article, menu, advert and so on) as a prior. Where a page marks its
article by an element, the slots that this element fills are content, and the template's words between them stay, as nothing of an
article may go: of several article elements, those of half the words of the longest or more, without those of which the template holds
all words, so that they fill no slot (the longest stays); of a main element around an article, no more than its first heading where the
article has none. Inside of one that is only named so, blocks wholly of the
template go, unless all are: then the pages of the host are copies and the text is theirs. Elsewhere content is the slot with most words outside links, what
is nested in it, later rounds of it of half its words or more, and headings; blocks of which half the words or more are the template's are labels of the site and go.

The vectors are never gathered: a sum of hashes of (page, times) over the pages of a host stands for each. Pages are dealt
by host, and a host's pages to blocks of bounded size; a block hands on the tokens of at least LOCAL_SHARE of its pages,
so a host with a third of all pages is no single task. Tokens of one class are handed on by the same blocks.

Defined results: null or empty html, and a page without content, has the empty text and n_chars 0; a null or odd url is a
host of its own name; a host of fewer than `least_pages` pages repeats too little to have a template, so roles and sizes decide there;
repeated rows count as one page each and get equal texts; broken or truncated markup is read as far as it goes; an empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, cut, in_arrow, table

LEAST_PAGES = 3
LAYOUT_SHARE, LEAST_SHARE = 0.1, 0.8  # of a host's pages, for classes with a tag and for those of words alone
LOCAL_SHARE = 0.05
BLOCK_PAGES, BLOCK_BYTES = 256, 8 << 20
LEAST_CLASS = 2
BROADCAST_BYTES = 64 << 20
BROADCAST_HOSTS = 1_000_000  # of 24 bytes each

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
TOKEN = 2**63 - 1
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element names of the markup language.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_PARAGRAPH = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FLOWS = (RAW - {"title"}) | (VOID - {"hr"}) | {"button", "select", "picture", "audio", "video", "map", "meter", "progress", "output"}  # these end no block
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu"}
NOT_CONTENT = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "input", "header"}
NOT_CONTENT_WORDS = re.compile(r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|related|recommend\w*|footer|foot|header|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|respond|disqus|replies|reply|feedback|tags?|pager|pagination|search|toolbar|copyright|legal|hidden|skip|contentinfo|complementary)\d*", re.I)
COMMENTS = re.compile(r"(?:comments?|commentlist|respond|disqus|replies|reply|feedback)\d*", re.I)
HOLDERS = re.compile(r"(?:area|bar|block|box|buttons?|container|content|form|group|holder|inner|item|items|links?|list|panel|row|section|slot|unit|widget|wrap|wrapper|top|bottom|left|right|main|primary|secondary|site|page|posts?|articles?|this|thread|text|body|\d+)", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[-_\s])(?:article|content|entry|main|post|story|text|body)(?:$|[-_\s\d])", re.I)


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or url or "").lower()
    except ValueError:
        return url or ""


def _no_content(name: str) -> bool:
    """Whether a class or id names a menu, advert and so on: by its last part, or by its first one with only words for holders after it.

    Comments may be named by any part with only words for holders after it. What is said to have, or not to have, a menu is none.
    """
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if not parts:
        return False
    if NOT_CONTENT_WORDS.fullmatch(parts[-1]):
        return len(parts) == 1 or parts[-2].lower() not in ("has", "no", "with", "without")
    last = len(parts) - 1
    while last > 0 and HOLDERS.fullmatch(parts[last]):
        last -= 1
    return bool((COMMENTS if last else NOT_CONTENT_WORDS).fullmatch(parts[last]))


def role(tag: str, names: str) -> int:
    """-1: what stands inside is no content; 1: it is the article; 0: as the element around it."""
    if tag in NOT_CONTENT or tag in RAW:
        return -1
    if tag == "main":
        return 1
    if tag == "article":  # one comment, or one advert, may be an article element of that name
        return -1 if names and any(NOT_CONTENT_WORDS.fullmatch(re.split(r"[-_]", name)[0]) and _no_content(name) for name in names.split()) else 1
    if names and any(_no_content(name) for name in names.split()):
        return -1
    return 1 if names and tag in ("div", "section", "td") and CONTENT_NAMES.search(names) else 0


class Node:
    """A piece of a page: a tag, or the text between two. path is a hash of the open elements; area their role; block changes where a block ends.

    article: 3 inside of an article element, 2 inside of a main element alone, 1 inside of one that is named so, else 0.
    heading: 2 inside of a heading of the first rank, 1 of another. root: the number of outermost article elements so far.
    """

    __slots__ = ("kind", "token", "path", "area", "article", "block", "text", "link", "heading", "root")

    def __init__(self, kind: str, token: int, path: int, area: int, article: int, block: int, text: str, link: bool = False, heading: int = 0, root: int = 0) -> None:
        self.kind, self.token, self.path, self.area, self.article, self.block, self.text, self.link, self.heading, self.root = kind, token, path, area, article, block, text, link, heading, root


_PATHS: dict[tuple[int, str], int] = {}


def _hash(path: int, text: str) -> int:
    key = (path, text)
    got = _PATHS.get(key)
    if got is None:
        got = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=path) >> 1
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        if len(text) <= 64:
            _PATHS[key] = got
    return got


def nodes(page: str) -> Iterator[Node]:
    """The pieces of a whole page, in order. Open elements are closed as the markup language implies it.

    Inline elements make no path. Those that are hidden or have the role of no content are kept open for their role alone,
    and so are those of the same name inside of them.
    """
    open_: list[tuple[str, int, int, int, int]] = []  # tag, path hash, area, article, in heading
    opened: Counter[str] = Counter()
    block, at, path, area, article, heading, links, root = 0, 0, 1, 0, 0, 0, 0, 0

    def pop_to(k: int) -> None:
        nonlocal path, area, article, heading
        for x in open_[k:]:
            opened[x[0]] -= 1
        del open_[k:]
        path, area, article, heading = open_[-1][1:] if open_ else (1, 0, 0, 0)

    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            yield Node("text", 0, path, area, article, block, page[at:end], links > 0, heading, root)
        if not m:
            return
        at = m.end()
        if m[1] is None:  # a comment or declaration
            continue
        tag, closing = m[1].lower(), m[0][1] == "/"
        if tag in INLINE or tag in ("br", "wbr"):
            if tag == "br":
                yield Node("text", 0, path, area, article, block, " ", root=root)
            if tag == "a":
                links = max(links - 1, 0) if closing else 1
            if closing:
                if opened[tag]:
                    k = len(open_) - 1
                    while open_[k][0] in INLINE and open_[k][0] != tag:
                        k -= 1
                    if open_[k][0] == tag:
                        pop_to(k)
            elif opened[tag] and not m[0].endswith("/>"):
                open_.append((tag, path, area, article, heading))
                opened[tag] += 1
            elif m[2] and not m[0].endswith("/>") and tag not in VOID and role("span", _names(m[2])) < 0 or HIDDEN.search(m[2] or ""):
                open_.append((tag, path, -1, article, heading))
                opened[tag] += 1
                area = -1
            continue
        ends = tag not in FLOWS
        if ends:
            links = 0
        if closing:
            block += ends
            if opened[tag]:
                k = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag)
                yield Node("tag", _hash(open_[k][1], "/") & ~1, open_[k][1], open_[k][2], open_[k][3], block, "")
                pop_to(k)
            continue
        if tag in CLOSES_PARAGRAPH and opened["p"]:
            k = len(open_) - 1
            while open_[k][0] in INLINE:
                k -= 1
            if open_[k][0] == "p":
                pop_to(k)
        if tag in SAME_LEVEL and any(opened[x] for x in SAME_LEVEL[tag]):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in SAME_LEVEL[tag]:
                    pop_to(k)
                elif open_[k][0] in SCOPES:
                    break
        block += ends
        names = _names(m[2]) if m[2] else ""
        own = role(tag, names)
        if m[2] and HIDDEN.search(m[2]):
            own = -1
        here = -1 if own < 0 and not (article and tag == "header") or area < 0 else max(area, own)
        token = _hash(path, f"{tag} {names}") & ~1
        inside, title = max(article, {"article": 3, "main": 2}.get(tag, 1) * (own > 0)), max(heading, (tag in HEADINGS) + (tag == "h1"))
        root += inside == 3 > article
        yield Node("tag", token, path, here, inside, block, "")
        if tag in VOID or m[0].endswith("/>"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        open_.append((tag, token, here, inside, title))
        opened[tag] += 1
        path, area, article, heading = token, here, inside, title


def _names(attributes: str) -> str:
    return " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes))


STORED_WORDS = 400_000


class _Words(dict):
    """Hashes of words, each made once; long words are not kept."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
        if len(self) > STORED_WORDS:
            self.clear()
        if len(w) <= 64:
            self[w] = h
        return h


_WORDS = _Words()


def word_tokens(path: int, text: str) -> list[int]:
    """The tokens of a text's words: odd numbers, hashed from word and path."""
    path, known = path * 0x9E3779B97F4A7C15 & TOKEN, _WORDS
    return [(known[w] ^ path) | 1 for w in _decoded(text).split()]


def _decoded(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def page_tokens(found: list[Node]) -> list[list[int]]:
    """For each node its tokens: itself for a tag, its words for a text. Tokens of tags are even, those of words odd."""
    return [[n.token] if n.kind == "tag" else word_tokens(n.path, n.text) for n in found]


def vector_hash(page_key: int, times: int) -> int:
    """What a page adds to the hash of an occurrence vector: a 63-bit number."""
    return xxhash.xxh3_64_intdigest(times.to_bytes(8, "little"), seed=page_key) >> 1


def host_key(url: str | None) -> int:
    """A 63-bit hash of the host's name, which stands for it in all that is counted."""
    return _hash(0, host(url))


def blocks(df: DataFrame, broadcast_rows: int = BROADCAST_HOSTS) -> DataFrame:
    """df (key, host, html) with all_pages, the pages of the host, and block, the part of them that a page is dealt to.

    The counts of few hosts are broadcast; many are joined by (host, salt), so that no host's pages meet in one task.
    """
    size = df.groupBy("host").agg(F.count("*").alias("all_pages"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    count = cut(size.select("host", "all_pages", F.ceil(F.greatest(F.col("all_pages") / BLOCK_PAGES, F.col("bytes") / BLOCK_BYTES, F.lit(1))).alias("parts")))
    if count.count() <= broadcast_rows:
        met = df.join(F.broadcast(count), "host")
    else:
        salted = count.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        met = df.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(salted, ["host", "salt"]).drop("salt")
    return met.withColumn("block", F.pmod("key", "parts"))


def occurrences(df: DataFrame, least_pages: int = LEAST_PAGES, broadcast_rows: int = BROADCAST_HOSTS) -> DataFrame:
    """host, all_pages, token, pages, v0, v1 of the whole table of (key, host, html): sums over the pages of a host."""

    def count(part: pa.Table) -> pa.Table:
        n, whole = part.num_rows, part.column("all_pages")[0].as_py()
        times = [(key & (2**63 - 1), Counter(chain.from_iterable(page_tokens(list(nodes(page or "")))))) for key, page in zip(part.column("key").to_pylist(), part.column("html").to_pylist(), strict=True)]
        support: Counter[int] = Counter()
        for _, c in times:
            support.update(c.keys())
        least = max(least_pages if n == whole else 1, LOCAL_SHARE * n)
        often = {t: 0 for t, s in support.items() if s >= least}
        for key, c in times:
            for t in often.keys() & c.keys():
                often[t] = (often[t] + vector_hash(key, c[t])) & (2**64 - 1)
        tokens = list(often)
        vector = np.array([often[t] for t in tokens], dtype=np.uint64)
        columns = [np.full(len(tokens), part.column("host")[0].as_py()), np.full(len(tokens), whole), np.array(tokens, dtype=np.int64), np.array([support[t] for t in tokens], dtype=np.int64), (vector >> np.uint64(32)).astype(np.int64), (vector & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return pa.table(columns, names=["host", "all_pages", "token", "pages", "high", "low"])

    part = blocks(df, broadcast_rows).groupBy("host", "block").applyInArrow(lambda t: count(t), "host long, all_pages long, token long, pages long, high long, low long")
    # 64-bit sums that wrap around: added as two halves, so that no mode of arithmetic fails
    added = part.groupBy("host", "all_pages", "token").agg(F.sum("pages").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    carried = (F.col("high") + F.shiftright("low", 32)).bitwiseAND(0xFFFFFFFF)
    return added.select("host", "all_pages", "token", "pages", carried.alias("v1"), F.col("low").bitwiseAND(0xFFFFFFFF).alias("v0"))


def hosts(df: DataFrame) -> DataFrame:
    """df with its host's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("url")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_key(u) for u in b.column(at).to_pylist()], pa.int64())], names=[*b.schema.names, "host"])

    return in_arrow(df, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", host long")


def template_classes(df: DataFrame, least_pages: int = LEAST_PAGES, layout_share: float = LAYOUT_SHARE, least_share: float = LEAST_SHARE, least_class: int = LEAST_CLASS, broadcast_rows: int = BROADCAST_HOSTS) -> DataFrame:
    """host, token, class, pages of the template's classes of (key, url, html).

    What stands on a fixed share of a host's pages is bounded by the length of a page, not by the number of pages.
    """
    often = occurrences(hosts(df).select("key", "host", "html"), least_pages, broadcast_rows).where((F.col("pages") >= least_pages) & (F.col("pages") >= layout_share * F.col("all_pages")))
    often = cut(often)
    same = ["host", "v0", "v1", "pages"]
    sizes = often.groupBy(*same).agg(F.count("*").alias("size"), F.min("token").alias("class"), F.max((F.col("token").bitwiseAND(1) == 0) | (F.col("pages") >= least_share * F.col("all_pages"))).alias("fine"))
    return often.join(sizes.where((F.col("size") >= least_class) & F.col("fine")), same).select("host", "token", "class", "pages")


def in_order(order: list[tuple[int, int]]) -> dict[int, list[int]]:
    """The classes of a page whose tokens keep one order in every round, with that order. order: (class, token) as they stand on the page."""
    seen: dict[int, list[int]] = {}
    for c, t in order:
        seen.setdefault(c, []).append(t)
    good = {}
    for c, ts in seen.items():
        n = len(set(ts))
        if len(ts) % n == 0 and all(ts[k : k + n] == ts[:n] for k in range(n, len(ts), n)):
            good[c] = ts[:n]
    return good


class Slots:
    """The template tree of one page: rounds of classes, nested by their gaps. Slot 0 is what is outside all rounds."""

    def __init__(self, order: list[tuple[int, int]]) -> None:
        self.good, dropped = in_order(order), True
        while dropped:
            dropped = self._nest([x for x in order if x[0] in self.good])
            for c in dropped:
                del self.good[c]

    def _nest(self, order: list[tuple[int, int]]) -> set[int]:
        """Makes the tree; the classes of rounds that cross another, if any, stop it."""
        self.parent, self.rule, self.after = [-1], [(0, 0)], []  # of slots: the slot around, (class, gap); the slot behind each token of order
        open_: list[list[int]] = []  # class, tokens seen, slot around
        inside, crossing = set(), set()
        slot = 0
        for c, _ in order:
            if c in inside:
                while open_[-1][0] != c:
                    crossing.add(open_[-1][0])
                    inside.discard(open_.pop()[0])
                open_[-1][1] += 1
            else:
                open_.append([c, 1, slot])
                inside.add(c)
            _, seen, around = open_[-1]
            if seen == len(self.good[c]):
                inside.discard(open_.pop()[0])
                slot = around
            else:
                slot = len(self.parent)
                self.parent.append(around)
                self.rule.append((c, seen))
            self.after.append(slot)
        crossing.update(x[0] for x in open_ if x[1] < len(self.good[x[0]]))
        return crossing

    def within(self, slot: int, outer: int) -> bool:
        while slot > outer:
            slot = self.parent[slot]
        return slot == outer


def extract(page: str | None, template: dict[int, int]) -> str:
    """The text of a page's content slots. template: token -> class, of the page's host. See the module's text for the choice."""
    if not page:
        return ""
    found = list(nodes(page))
    level = max((n.article for n in found if n.area >= 0 and n.kind == "text" and n.text.strip()), default=0)
    tokens = page_tokens(found)
    tree = Slots([(template[t], t) for ts in tokens for t in ts if t in template])
    if level >= 2:
        inside = [(n, ts) for n, ts in zip(found, tokens, strict=True) if n.kind == "text" and n.area >= 0 and n.article >= 2]
        held = {t for t, c in template.items() if c in tree.good}
        filled = [len(ts) - sum(map(held.__contains__, ts)) for _, ts in inside]
        return _joined(_marked([n for n, _ in inside], filled, level))
    slot, number = 0, 0
    texts: dict[int, list] = {}  # block -> its pieces, words, words of the template, slots, whether it is a heading
    free: Counter[int] = Counter()  # words of slots, outside links
    total: Counter[int] = Counter()
    for n, ts in zip(found, tokens, strict=True):
        b = texts.setdefault(n.block, [[], 0, 0, Counter(), n.heading]) if n.kind == "text" and n.area >= 0 and n.article == level else None
        if b:
            b[0].append(n.text)
        for t in ts:
            if template.get(t) in tree.good:
                slot = tree.after[number]
                number += 1
                if b:
                    b[2] += 1
            elif b:
                b[3][slot] += 1
                total[slot] += 1
                free[slot] += not n.link
        if b:
            b[1] += len(ts)
    blocks_ = [b for b in texts.values() if b[1]]
    if level:
        chosen = [b for b in blocks_ if b[2] < b[1]] or blocks_
    else:
        chosen = _chosen(blocks_, tree, free, total)
    return _joined(b[0] for b in chosen)


def _joined(blocks_: Iterable[list[str]]) -> str:
    lines = (" ".join(_decoded("".join(b)).split()) for b in blocks_)
    return "\n".join(t for t in lines if t)


def _marked(inside: list[Node], filled: list[int], level: int) -> Iterable[list[str]]:
    """The blocks of a page whose article is marked, from its nodes in article and main elements, and how many words of each fill slots."""
    size: Counter[int] = Counter()
    fills: Counter[int] = Counter()
    for n, free in zip(inside, filled, strict=True):
        if n.article == level and not n.link:
            size[n.root] += len(n.text.split())
            fills[n.root] += free
    longest = max(size.values(), default=0)
    long = {r for r, words in size.items() if level == 2 or words == longest or 2 * words >= longest and fills[r]}
    titled = level == 2 or any(n.heading == 2 for n in inside if n.article == 3 and n.root in long)
    lines: dict[int, list[str]] = {}
    for n in inside:
        if n.article == level and (level == 2 or n.root in long) or not titled and n.heading == 2 and n.article == 2:
            lines.setdefault(n.block, []).append(n.text)
    return lines.values()


def _chosen(blocks_: list[list], tree: Slots, free: Counter, total: Counter) -> list[list]:
    """The blocks of a page without a marked article that are content."""
    varied = [b for b in blocks_ if 2 * b[2] < b[1]]
    if not varied:  # the pages of the host are copies, and the text is theirs
        return blocks_
    mass: Counter[int] = Counter()  # free words of a slot and of all within it, for slots in which text stands
    for s, n in free.items():
        mass[s] += n
    main = max(mass, key=lambda s: (mass[s], -s)) if mass else 0
    alike = {s for s in mass if s == main or tree.rule[s] == tree.rule[main] and 2 * mass[s] >= mass[main]}
    links = lambda s: 2 * free[s] < total[s]
    fine = {s for s in total if (s in alike or any(tree.within(s, x) for x in alike if x)) and not links(s)}
    return [b for b in varied if any(s in fine or b[4] and not links(s) for s in b[3])]


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row of df."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    classes = cut(template_classes(pages.select(F.xxhash64("page_id", "html").alias("key"), "url", "html"), least_pages))
    rows = classes.count()

    def made(ids, urls, texts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kind}, url string, text string, n_chars long"
    if rows * 24 <= broadcast_bytes:  # few hosts: their templates go to all tasks
        got = classes.select("host", "token", "class").toPandas()
        state = (got["host"].to_numpy(), got["token"].to_numpy(), got["class"].to_numpy())
        shared = Shared(spark, state, _by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of = shared.get()
                yield made(b.column(0), b.column(1), [extract(p, of.get(host_key(u), {})) for u, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])

        return in_arrow(pages, run, schema)
    # many hosts: pages meet their host's template in a join by (host, salt), so that no host is a single task
    per_host = classes.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("template")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    joined = hosts(pages).withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(16)).cast("int")).join(per_host, ["host", "salt"], "left").select("page_id", "url", "html", "template")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            templates = [{x["token"]: x["class"] for x in t or []} for t in b.column(3).to_pylist()]
            yield made(b.column(0), b.column(1), [extract(p, t) for p, t in zip(b.column(2).to_pylist(), templates, strict=True)])

    return in_arrow(joined, run_joined, schema)


def _by_host(state: tuple) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = {}
    for h, t, c in zip(*(x.tolist() for x in state), strict=True):
        out.setdefault(h, {})[t] = c
    return out


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
