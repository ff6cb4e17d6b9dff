"""Main text of web pages through wrappers inferred for every host.

A wrapper is a union-free regular expression over the block elements of a host's pages:
elements, text slots, optional groups and repeated groups. It starts as the first page
and is aligned with page after page. Where two texts differ there is a slot; equal
neighbours, alone or as a sequence, become a repeated group; what only one side has
becomes optional. Every task does this for the hosts it meets, and the partial
wrappers, which are small, are aligned with each other in the same way.

A page gives the texts of its article and main element. Where it marks none, the wrapper tells which
texts belong to the host rather than to the page, and the element with most text left
is taken.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, stored, texts_of

# Fixed values of HTML and of common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q"
    " rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "aside audio button canvas dialog footer form head iframe map math menu nav noembed noframes"
    " noscript object script select style svg template textarea title video xmp".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search"
    " toolbar".split()
)
READER_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo"
    " promotion related recommended recommendations teaser".split()
)
CHROME_WORDS = frozenset(
    "alert breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr login menu modal nav"
    " navbar navigation newsletter notice notices notification overlay pager pagination popup share"
    " sharing sidebar signup social subscribe subscription toolbar widget masthead topbar".split()
)
# A name in an article that is nothing but such words and words for a part of a page.
CHROME_NAME = re.compile(
    rf"(?:(?:{'|'.join(sorted(READER_WORDS | OTHER_WORDS | CHROME_WORDS))})[-_]*)+"
    r"(?:(?:area|banner|bar|block|box|button|buttons|container|form|icons|inner|item|items|links"
    r"|list|panel|posts|section|slot|unit|widget|wrap|wrapper)[-_]*)*\d*"
)
DENIED = frozenset("no not has with without hide".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | {"p", "li", "blockquote", "pre", "td"}

# Longest sequence of siblings that is recognised as a repeated group.
LONGEST_GROUP = 4
# Texts that all pages of a host share are its own from this many pages on.
LEAST_PAGES = 5
# Hosts whose wrappers a task holds before it hands them on.
HOSTS_HELD = 2_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    sign: str
    dropped: bool = False
    heads_only: bool = False
    main: int = 0
    parent: Element | None = None
    link: bool = False
    path: str = ""
    number: int = 0


@dataclass
class Block:
    holder: Element
    text: str
    linked: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tree: list = field(default_factory=list)


def _marks(attributes: dict[str, str]) -> set[str]:
    found: set[str] = set()
    for name in ("class", "id"):
        for value in attributes.get(name, "").split():
            parts = [p.lower() for p in _PART.findall(value)]
            if not DENIED & set(parts):
                found.update(parts)
    return found


def _names(attributes: dict[str, str]) -> set[str]:
    """Whole class names and the id."""
    return {v.lower() for name in ("class", "id") for v in attributes.get(name, "").split()}


def _element(tag: str, written: str, parent: Element | None) -> Element:
    attributes = {
        m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(written)
    } if written.strip() else {}
    sign = tag
    if attributes.get("class"):
        sign += "." + re.sub(r"\d+", "N", attributes["class"].strip())
    element = Element(tag, sign, parent=parent)
    if parent is not None:
        element.dropped, element.main = parent.dropped, parent.main
        element.heads_only, element.link = parent.heads_only, parent.link
    if attributes:
        marks = _marks(attributes)
        style = attributes.get("style", "").replace(" ", "").lower()
        hidden = (
            "hidden" in attributes
            or attributes.get("aria-hidden", "").lower() == "true"
            or "display:none" in style
            or "visibility:hidden" in style
        )
        if tag in ("html", "body", "main"):
            hidden = False
        elif tag == "article":
            hidden = hidden or bool(marks & (READER_WORDS | OTHER_WORDS))
        else:
            if tag in HEADINGS or tag == "p":
                # Titles make ids, and notices are text; a whole class may still name an advert.
                marks = OTHER_WORDS & set(attributes.get("class", "").lower().split())
            elif parent is not None and parent.main:
                # In the article a word is part of many a name: only whole ones tell.
                marks = _names(attributes)
                hidden = hidden or any(CHROME_NAME.fullmatch(name) for name in marks)
            hidden = hidden or bool(marks & (READER_WORDS | OTHER_WORDS | CHROME_WORDS))
            hidden = hidden or attributes.get("role", "").lower() in DROPPED_ROLES
            element.heads_only |= "header" in marks
        element.dropped |= hidden
        if attributes.get("role", "").lower() == "main":
            element.main = max(element.main, 1)
    element.dropped |= tag in DROPPED
    element.heads_only |= tag == "header"
    element.link |= tag == "a"
    if tag == "main":
        element.main = max(element.main, 1)
    elif tag == "article":
        element.main = 2
    return element


def parse(page: str) -> Page:
    """The text blocks of a page in order, and its tree of block elements."""
    out = Page()
    root = Element("", "")
    stack = [root]
    nodes: list[list] = [out.tree]
    words: list[str] = []
    linked = 0
    block = root
    numbers = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            out.blocks.append(Block(block, text, linked))
            nodes[-1].append(["#", 0, 0, zlib.crc32(text.encode())])
        words.clear()
        linked = 0

    def close(depth: int) -> None:
        """Leave all elements from this depth on."""
        nonlocal block
        if any(e.tag not in INLINE for e in stack[depth:]):
            flush()
        while len(stack) > depth:
            gone = stack.pop()
            if gone.tag not in INLINE:
                nodes.pop()
        block = next(e for e in reversed(stack) if e.tag not in INLINE)

    def depth_of(tags: set[str], within: set[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in within:
                break
        return 0

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.match(page, at)
        at = match.end()
        tag = match[2]
        if tag is None:
            piece = match[0]
            if piece[0] != "<" or piece == "<":
                here = stack[-1]
                kept = not here.dropped
                if kept and here.heads_only:
                    kept = any(e.tag in HEADINGS for e in stack) and block.main > 0
                if kept:
                    piece = html.unescape(piece)
                    words.append(piece)
                    if here.link:
                        linked += len(piece)
            continue
        tag = tag.lower()
        if match[1]:
            depth = depth_of({tag}, set() if tag not in INLINE else {block.tag})
            if depth:
                close(depth)
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            after = page.find(">", closing.start()) if closing else -1
            at = after + 1 if after >= 0 else end
            continue
        if tag in VOID:
            if tag == "br" and not stack[-1].dropped:
                words.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            depth = depth_of({"p"} | HEADINGS if tag in HEADINGS else {"p"}, {"table", "button", "object"})
            if depth:
                close(depth)
            if tag in CLOSED_BY:
                depth = depth_of(CLOSED_BY[tag], SCOPES.get(tag, {"table"}))
                while depth:
                    close(depth)
                    depth = depth_of(CLOSED_BY[tag], SCOPES.get(tag, {"table"}))
            flush()
        element = _element(tag, match[3], stack[-1])
        stack.append(element)
        if tag not in INLINE:
            numbers += 1
            element.number = numbers
            element.path = f"{block.path}/{element.sign}"
            children: list = []
            nodes[-1].append([element.sign, 0, 0, children])
            nodes.append(children)
            block = element
    flush()
    return out


# Wrappers. A node is [sign, optional, repeated, children], a text ["#", optional,
# repeated, checksum or None for a slot]; a repeated sequence has the sign "()".


def _sign(node: list) -> str:
    return "(" + " ".join(map(_sign, node[3])) + ")" if node[0] == "()" else node[0]


def _merge(a: list, b: list) -> list:
    if a[0] == "#":
        same = a[3] is not None and a[3] == b[3]
        return ["#", a[1] | b[1], a[2] | b[2], a[3] if same else None]
    return [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3])]


def fold(nodes: list) -> list:
    """Neighbours, alone or in sequence, that are alike become one repeated group."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list = []
        signs: list[str] = []
        for node in nodes:
            out.append(node)
            signs.append(_sign(node))
            while len(out) >= 2 * size and signs[-size:] == signs[-2 * size : -size]:
                if size == 1 and out[-1][0] != "#" or size > 1:
                    last = out[-size:]
                    first = out[-2 * size : -size]
                    del out[-2 * size :], signs[-2 * size :]
                    merged = [_merge(x, y) for x, y in zip(first, last)]
                    if size == 1:
                        merged[0][2] = 1
                    else:
                        merged = [["()", 0, 1, merged]]
                    out += merged
                    signs += map(_sign, merged)
                else:
                    last = out.pop()
                    signs.pop()
                    out[-1] = _merge(out[-1], last)
                    out[-1][2] = 1
                if size > 1:
                    break
            if len(out) >= 2 and size > 1 and out[-1][0] == "()" and signs[-1] == signs[-2]:
                last = out.pop()
                signs.pop()
                out[-1] = _merge(out[-1], last)
                out[-1][2] = 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """One expression for both sequences; what only one of them has is optional."""
    if not a or not b:
        return [[n[0], 1, n[2], n[3]] for n in (a or b)]
    places: dict[str, list[int]] = {}
    for k, node in enumerate(a):
        places.setdefault(_sign(node), []).append(k)
    out, done = [], 0
    for node in b:
        where = places.get(_sign(node), [])
        k = bisect_right(where, done - 1)
        if k < len(where):
            out += [[n[0], 1, n[2], n[3]] for n in a[done : where[k]]]
            out.append(_merge(a[where[k]], node))
            done = where[k] + 1
        else:
            out.append([node[0], 1, node[2], node[3]])
    out += [[n[0], 1, n[2], n[3]] for n in a[done:]]
    return fold(out)


def folded(tree: list) -> list:
    return fold([n if n[0] == "#" else [n[0], n[1], n[2], folded(n[3])] for n in tree])


def join_wrappers(a: dict | None, b: dict) -> dict:
    return b if a is None else {"pages": a["pages"] + b["pages"], "tree": align(a["tree"], b["tree"])}


def expression(tree: list) -> str:
    """A wrapper in the usual notation."""
    parts = []
    for sign, optional, repeated, below in tree:
        inner = ("#" if below is None else "text") if sign == "#" else expression(below)
        one = inner if sign == "#" else inner if sign == "()" else f"<{sign}>{inner}</>"
        mark = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
        parts.append(f"({one}){mark}" if mark else one)
    return " ".join(parts)


@lru_cache(maxsize=4096)
def shared_texts(wrapper: str) -> frozenset[tuple[str, int]]:
    """Path and checksum of texts that every page of the host has in the same place."""
    found: set[tuple[str, int]] = set()
    loaded = json.loads(wrapper)
    if loaded["pages"] < LEAST_PAGES:
        return frozenset()

    def walk(nodes: list, path: str) -> None:
        for sign, optional, repeated, below in nodes:
            if optional or repeated:
                continue
            if sign == "#":
                if below is not None:
                    found.add((path, below))
            else:
                walk(below, path if sign == "()" else f"{path}/{sign}")

    walk(loaded["tree"], "")
    return frozenset(found)


def main_text(page: str, wrapper: str | None) -> str:
    blocks = parse(page).blocks
    marked = [b.text for b in blocks if b.holder.main]
    if marked:
        return "\n".join(marked)
    own = shared_texts(wrapper) if wrapper else frozenset()
    left = [
        b
        for b in blocks
        if 2 * b.linked <= len(b.text) and (b.holder.path, zlib.crc32(b.text.encode())) not in own
    ]
    weight: dict[int, float] = {}
    for b in left:
        holder = _outer(b.holder) if b.holder.tag in LEAVES else b.holder
        share = float(len(b.text))
        while holder is not None and share >= 1:
            weight[holder.number] = weight.get(holder.number, 0) + share
            holder, share = _outer(holder), share / 2
    if not weight:
        return ""
    best = max(weight, key=lambda n: (weight[n], -n))
    return "\n".join(b.text for b in left if _under(b.holder, best))


def _outer(element: Element) -> Element | None:
    element = element.parent
    while element is not None and element.tag in INLINE:
        element = element.parent
    return element


def _under(element: Element | None, number: int) -> bool:
    while element is not None:
        if element.number == number and element.tag not in INLINE:
            return True
        element = element.parent
    return False


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(
        F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1
    )
    return pages.withColumn("_host", F.lower(host))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``_host`` and ``wrapper`` (JSON), from all pages of every host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[str, dict] = {}

        def rows() -> pa.RecordBatch:
            made = [json.dumps(w, separators=(",", ":")) for w in held.values()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([task % 64] * len(held), pa.int32()),
                 pa.array(made, pa.string())],
                ["_host", "part", "wrapper"],
            )
            held.clear()
            return batch

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                one = {"pages": 1, "tree": folded(parse(page).tree)}
                held[host] = join_wrappers(held.get(host), one)
                if len(held) > HOSTS_HELD:
                    yield rows()
        yield rows()

    def join_all(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for wrapper in sorted(rows["wrapper"]):
            whole = join_wrappers(whole, json.loads(wrapper))
        first = rows.iloc[[0]].copy()
        first["wrapper"] = json.dumps(whole, separators=(",", ":"))
        return first

    schema = "_host string, part int, wrapper string"
    parts = pages.select("_host", "html").mapInArrow(partial, schema)
    parts = parts.groupBy("_host", "part").applyInPandas(join_all, schema)
    return parts.groupBy("_host").applyInPandas(join_all, schema).select("_host", "wrapper")


# Wrappers are sent to every executor up to this size in all, else joined by host.
WRAPPER_BYTES = 16 << 20


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Takes ``page_id``, ``url`` and ``html``; other columns are ignored. A null or empty
    page has an empty text; pages without a host share a wrapper; repeated rows stay.
    """
    source = with_host(pages.select("page_id", "url", F.col("html").cast("string")))
    wrappers = stored(infer_wrappers(source), "wrappers")
    total = wrappers.agg(F.sum(F.length("wrapper") + F.length("_host"))).first()[0] or 0
    joined = source.join(F.broadcast(wrappers) if total <= WRAPPER_BYTES else wrappers, "_host", "left")

    def handle(batch: pa.RecordBatch):
        pages = texts_of(batch.column(2))
        texts = [main_text(page, w) for page, w in zip(pages, batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    ordered = joined.select(F.col("page_id").cast("long"), "url", "html", "wrapper")
    return by_batch(ordered, handle, "page_id long, url string, text string, n_chars long")
