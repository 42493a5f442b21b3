"""Main text of web pages by wrapper induction over each host's pages."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, drop, save
from .text import slices

#: Pages of a host that the tree of its wrapper is aligned from, at most. Which texts are constant is counted on all its pages.
SAMPLES = 6
#: A text at one slot is template if more than this percentage of a host's different articles have it, and at least so many.
MOST_PERCENT, LEAST_ARTICLES = 50, 3

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Fixed values of the HTML language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES_P = _BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl body html article section div main td th aside nav footer header form".split())
# Elements and roles that HTML defines as something else than the article.
_OTHER_TAGS = frozenset("head script style nav footer aside form noscript iframe button select textarea template svg canvas object dialog menu input label title link meta".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Names that pages give to menus, adverts, notices, forms, comments; and what they are often joined with.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond replies disqus related recommended recommendations pagination pager toolbar search tags paywall".split()
)
_JOINED = frozenset("area bar block bottom box button buttons container content form global group header icons inner item items left links list main media outer page panel post posts right section site slot stories thread top unit widget wrap wrapper zone".split())
_NAMED_TAGS = frozenset("div section ul ol dl table span fieldset details".split())
# Classes and ids of a page's header; inside an article or main element they mark its own head, which stays.
_HEADER_NAMES = frozenset("header site-header topbar".split())


class Node:
    """An element of a page. ``other``: no content by HTML's own meaning; ``named``: by the name that the page gives it."""

    __slots__ = ("tag", "label", "other", "named", "inside", "children")

    def __init__(self, tag: str, label: str, inside: bool):
        self.tag, self.label, self.inside, self.other, self.named, self.children = tag, label, inside, False, False, []


def _is_name(token: str) -> bool:
    parts = re.split("[-_]+", token.strip("-_"))
    return not _NAMES.isdisjoint(parts) and all(x in _NAMES or x in _JOINED for x in parts)


def _make(tag: str, raw: str, parent: Node) -> Node:
    node, names = Node(tag, tag, parent.inside or tag in ("article", "main")), []
    node.other = tag in _OTHER_TAGS
    if raw and not raw.isspace():
        given = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(raw)}
        classes = given.get("class", "").split()
        names = classes + given.get("id", "").split()
        if classes:
            node.label = f"{tag} {' '.join(sorted(re.sub('[0-9]+', '#', x) for x in classes))}"
        node.named = tag in _NAMED_TAGS and any(map(_is_name, names))
        node.other |= given.get("role") in _OTHER_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    node.other |= not node.inside and (tag == "header" or tag in ("div", "section") and not _HEADER_NAMES.isdisjoint(names))
    return node


def parse(page: str) -> Node:
    """A DOM tree as browsers would roughly build it: unclosed and misplaced tags are tolerated, at any depth."""
    root = Node("#root", "#root", False)
    open_, at = [root], 0
    depths: dict[str, list[int]] = {}
    scopes = [0]

    def shut(depth: int) -> None:
        while len(open_) > depth:
            tag = open_.pop().tag
            depths[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                open_[-1].children.append(page[at:])
            return root
        if m.start() > at:
            open_[-1].children.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group(0).startswith("<![CDATA["):
                open_[-1].children.append(m.group(0)[9:].removesuffix("]]>"))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            found = depths.get(tag)
            if found and (tag in _BLOCKS or found[-1] >= scopes[-1]):
                shut(found[-1])
            continue
        if tag in _CLOSES_P or tag in _SIBLINGS:
            found = max((depths[t][-1] for t in ({"p"} if tag in _CLOSES_P else _SIBLINGS[tag]) if depths.get(t)), default=-1)
            if found > 0 and found >= scopes[-1]:
                shut(found)
        node = _make(tag, m.group(3), open_[-1])
        open_[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag not in ("noscript", "template") and end is None and tag in ("title", "textarea"):
                continue
            at = end.end() if end else len(page)
        elif tag not in _VOID and not m.group(3).endswith("/"):
            depths.setdefault(tag, []).append(len(open_))
            if tag in _SCOPE:
                scopes.append(len(open_))
            open_.append(node)


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


class Part:
    """A node of a wrapper. A part that ``repeats`` stands for one or more siblings in a row; ``support``: pages that have it."""

    __slots__ = ("label", "repeats", "support", "seen", "number", "children")

    def __init__(self, label: str, repeats: bool = False):
        self.label, self.repeats, self.support, self.seen, self.number, self.children = label, repeats, 0, 0, -1, []


def align(wrapper: Part, page: Node) -> tuple[int, list[tuple[Part, Node]]]:
    """Simple tree matching: the largest order- and ancestor-preserving matching of equal labels, and its pairs, top down.

    Of the children of two matched nodes a heaviest common subsequence is matched, by dynamic
    programming over sums of their own matchings; a part that repeats may take several
    children in a row. Nothing recurses, so depth is no limit, and the same rule serves every size.
    """
    if wrapper.label != page.label:
        return 0, []
    pairs: list[tuple[Part, Node]] = [(wrapper, page)]
    below: list[dict[tuple[int, int], int]] = []
    sizes: list[tuple[int, int]] = []
    for w, x in pairs:  # grows while it is read
        right, own = elements(x), {}
        if w.children and right:
            by_label: dict[str, list[int]] = {}
            for j, y in enumerate(right):
                by_label.setdefault(y.label, []).append(j)
            for i, v in enumerate(w.children):
                for j in by_label.get(v.label, ()):
                    own[i, j] = len(pairs)
                    pairs.append((v, right[j]))
        below.append(own)
        sizes.append((len(w.children), len(right)))
    score = [1] * len(pairs)
    tables: dict[int, np.ndarray] = {}
    for k in range(len(pairs) - 1, -1, -1):
        if not below[k]:
            continue
        n, m = sizes[k]
        gain = np.zeros((n, m), np.int64)
        for (i, j), child in below[k].items():
            gain[i, j] = score[child]
        best = np.zeros((n + 1, m + 1), np.int64)
        for i in range(n):
            row = best[i].copy()
            row[1:] = np.maximum(row[1:], best[i, :-1] + gain[i])
            if pairs[k][0].children[i].repeats:
                total = np.concatenate(([0], np.cumsum(gain[i])))
                row = np.maximum.accumulate(row - total) + total
            best[i + 1] = np.maximum.accumulate(row)
        score[k] += int(best[n, m])
        tables[k] = best
    out, open_ = [], [0]
    while open_:
        k = open_.pop()
        out.append(pairs[k])
        if k not in tables:
            continue
        best, (i, j), chosen = tables[k], sizes[k], []
        while i and j:
            child = below[k].get((i - 1, j - 1))
            gain_ = score[child] if child is not None else 0
            if child is not None and best[i, j] == best[i - 1, j - 1] + gain_:
                chosen.append(child)
                i, j = i - 1, j - 1
            elif child is not None and pairs[k][0].children[i - 1].repeats and best[i, j] == best[i, j - 1] + gain_:
                chosen.append(child)
                j -= 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        open_.extend(chosen)
    return score[0], out


def _add(part: Part, page: Node) -> None:
    """Put the tree below ``page`` below ``part``; siblings of one label in a row become one part that repeats."""
    open_ = [(part, page)]
    while open_:
        w, x = open_.pop()
        for y in elements(x):
            last = w.children[-1] if w.children else None
            if last is not None and last.label == y.label:
                last.repeats = True
            else:
                last = next((v for v in w.children if v.label == y.label), None) if w.repeats else None
                if last is None:
                    last = Part(y.label)
                    w.children.append(last)
            open_.append((last, y))


def induce(pages: list[str]) -> str:
    """A wrapper of pages of one host: JSON of the number of pages and, in pre-order, each part's [parent, label, repeats, pages that have it].

    The pages' trees are aligned one after the other and what a page has besides is added at its
    place; of several pages only parts that at least two have stay.
    """
    trees = [parse(p) for p in dict.fromkeys(pages)]
    root = Part("#root")
    for number, tree in enumerate(trees, 1):
        matched = align(root, tree)[1]
        partner = {id(y): v for v, y in matched}
        for w, x in matched:
            w.support += w.seen != number
            w.seen = number
            at, taken = 0, set()
            for y in elements(x):
                v = partner.get(id(y))
                if v is not None:
                    v.repeats |= id(v) in taken
                    taken.add(id(v))
                    at = w.children.index(v, max(at - 1, 0)) + 1
                    continue
                last = w.children[at - 1] if at else None
                if last is not None and last.label == y.label and last.seen in (0, number):
                    last.repeats = True
                    v = last
                else:
                    v = Part(y.label)
                    w.children.insert(at, v)
                    at += 1
                _add(v, y)
                added = [v]
                while added:
                    u = added.pop()
                    u.support += u.seen != number
                    u.seen = number
                    added.extend(u.children)
    out: list[list] = []
    open_ = [(root, -1)]
    while open_:
        w, parent = open_.pop()
        if w.support >= min(2, len(trees)) or parent < 0:
            out.append([parent, w.label, int(w.repeats), w.support])
            open_.extend((v, len(out) - 1) for v in reversed(w.children))
    return json.dumps([len(trees), out], ensure_ascii=False)


@lru_cache(256)
def _wrapper(raw: str) -> tuple[int, Part]:
    n, spec = json.loads(raw)
    parts: list[Part] = []
    for parent, label, repeats, support in spec:
        part = Part(label, bool(repeats))
        part.number, part.support = len(parts), support
        if parent >= 0:
            parts[parent].children.append(part)
        parts.append(part)
    return n, parts[0]


class Block:
    """A line of text: ``key`` is its hash at its slot, ``region`` the article or else main element that it lies in."""

    __slots__ = ("text", "key", "region")

    def __init__(self, text: str, key: int, region: tuple[int, int]):
        self.text, self.key, self.region = text, key, region


def _hash(*parts) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def read(tree: Node, wrapper: str | None) -> list[Block]:
    """The page's blocks in order, each with its slot: the wrapper's part that its container is aligned with.

    Elements that HTML itself sets apart are left out. Those that only a name marks as menu, advert,
    comments and so on are left out if the wrapper has them as a part of half of its pages or more;
    where the host has too few pages to tell, the name decides.
    """
    slots: dict[int, Part] = {}
    enough = 0
    if wrapper is not None:
        n, root = _wrapper(wrapper)
        enough = n / 2 if n >= LEAST_ARTICLES else 0
        slots = {id(x): w for w, x in align(root, tree)[1]}
    out: list[Block] = []
    current: list[str] = []
    # the slot around the current block, its label, its article and main element
    state = (-1, "", (0, 0))
    inner, regions = -1, 0
    stack: list = [tree]

    def end() -> None:
        if current:
            text = " ".join(html.unescape("".join(current)).split())
            current.clear()
            if text:
                out.append(Block(text, _hash(*state[:2], text), state[2]))

    while stack:
        item = stack.pop()
        if isinstance(item, str):
            current.append(item)
        elif isinstance(item, tuple):
            end()
            state, inner = item
        elif item.other or item.named and (not enough or id(item) in slots and slots[id(item)].support >= enough):
            if item.tag in _BLOCKS:
                end()
        elif item.tag in ("br", "wbr", "img"):
            current.append(" " if item.tag == "br" else "")
        elif item.tag in _BLOCKS or item is tree:
            end()
            stack.append((state, inner))
            article, main = state[2]
            if item.tag == "article" and not article or item.tag == "main" and not main:
                regions += 1
                article, main = (regions, main) if item.tag == "article" else (article, regions)
            state = (inner, item.label, (article, main))
            if id(item) in slots:
                inner = slots[id(item)].number
            stack.extend(reversed(item.children))
        else:
            stack.extend(reversed(item.children))
    end()
    return out


def extract(page: str, wrapper: str | None, constant: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's article: blocks in varying slots, without those whose text is constant on the host.

    Blocks of all article elements count, or else of the main element, or else of the whole page, wherever
    they lie and however short they are. Where everything there is constant, it stays: it is what the page has.
    """
    blocks = read(parse(page), wrapper)
    chosen = [b for b in blocks if b.region[0]] or [b for b in blocks if b.region[1]] or blocks
    return "\n".join(b.text for b in [b for b in chosen if b.key not in constant] or chosen)


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([induce(p) for p in batch.column("pages").to_pylist()], pa.string())], ["host", "wrapper"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's different blocks, by key, with the article they belong to, known by its longest block."""
    for whole in batches:
        for batch in slices(whole, "html"):
            hosts, articles, keys = [], [], []
            for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                blocks = read(parse(page), wrapper)
                if blocks:
                    own = {b.key for b in blocks}
                    hosts += [host] * len(own)
                    articles += [_hash(max((b.text for b in blocks), key=len))] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(articles, pa.int64()), pa.array(keys, pa.int64())], ["host", "article", "key"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [extract(p or "", w, set(c or ())) for p, w, c in zip(*(batch.column(x).to_pylist() for x in ("html", "wrapper", "constant")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def _small(df: DataFrame, size) -> DataFrame:
    """``df`` with a broadcast hint if the sum of ``size`` stays under BROADCAST_BYTES, else unchanged (a shuffled join)."""
    return F.broadcast(df) if (df.select(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", content: str = "html", samples: int = SAMPLES, percent: int = MOST_PERCENT, least: int = LEAST_ARTICLES) -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``.

    1. Of each host (of the URL) at most ``samples`` pages, those with the smallest hash of the id under
    as many seeds, give a wrapper: their trees are aligned by simple tree matching into one tree of
    parts that two of them have.
    2. Every page is aligned with its host's wrapper, which gives each of its blocks a slot. A text that
    over ``percent`` of the host's articles, and at least ``least`` of them, have at one slot is
    template. All pages count, but copies once: pages with the same longest block are one article.
    3. A page's text is what its articles (or main element, or where it has neither the whole page) have
    in slots that vary: template is left out, as are elements that HTML sets apart (nav,
    aside, footer, form ...) and those that a name marks as menu, advert, notice or comments if the
    wrapper has them as well; on hosts too small for a wrapper (under ``least`` pages) the name decides.

    Blocks stand in page order, one to a line, references decoded and white space made one
    space; nothing else is dropped. A page whose URL is null or has no host is read without a wrapper. Null
    or empty html gives an empty text; depth and length of a page have no limit. Rows of a repeated or null id are read
    each for itself; other columns aren't used; an empty table gives no rows.

    The samples are chosen by minima and the texts counted by sums, both combined before the
    shuffle, so that a host with a third of all pages is no burden; wrappers and template texts are broadcast if they
    are proven small, else joined by host.
    """
    key = pages.schema[id].dataType.simpleString()
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(content).alias("html"), F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"))
    known = rows.where("host is not null and html is not null")
    sampled = known.where("id is not null")
    chosen = sampled.groupBy("host").agg(F.array_distinct(F.array(*(F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(samples)))).alias("ids")).select("host", F.explode("ids").alias("id"))
    chosen = _small(chosen, F.lit(64))
    wrappers = sampled.join(chosen, ["host", "id"]).groupBy("host", "id").agg(F.max("html").alias("html")).groupBy("host").agg(F.array_sort(F.collect_list("html")).alias("pages")).mapInArrow(_induce, "host string, wrapper string")
    wrappers = save(wrappers, "wrappers")
    aligned = known.select("host", "html").join(_small(wrappers, F.octet_length("wrapper") + F.octet_length("host") + 64), "host")
    slots = save(aligned.mapInArrow(_slots, "host string, article long, key long").distinct(), "slots")
    articles = slots.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    often = slots.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    constant = often.join(articles, "host").where(100 * F.col("n") > percent * F.col("articles")).groupBy("host").agg(F.collect_list("key").alias("constant"))
    hosts = save(wrappers.join(constant, "host", "left"), "hosts")
    drop(slots)
    hosts = _small(hosts, F.octet_length("wrapper") + 8 * F.coalesce(F.size("constant"), F.lit(0)) + F.octet_length("host") + 64)
    out = rows.join(hosts, "host", "left").select("id", "url", "html", "wrapper", "constant").mapInArrow(_extract, f"id {key}, url string, text string")
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
