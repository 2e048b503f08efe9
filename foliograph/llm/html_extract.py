"""Main text of web pages by template deduction over equivalence classes.

A page's tokens are its elements, by path, and its texts, by path and words. Over a host's different pages, tokens of one
occurrence vector form a class; vectors are compared by order-free digests, so a host's pages are never brought together.
A class is valid if its tokens come in one order on nearly all pages that hold it and its occurrences cross no better
class's. Valid classes nest, each in a slot between two tokens of another: that is the host's template. Its skeleton are
the classes that stand once on nearly every page. The main slot is the deepest skeleton element that holds nearly all
running text outside the template; a page's text is what stands there in slots, so texts of the template's classes go.

Tags and class words that tell of menus, headers, adverts, comments and the like break ties only: they weigh text when the
main slot is chosen, and leave off parts inside it. Marks on the main slot or around it don't count, nor do marks of forms
and class words where next to all text stands under one. A page costs time and memory in proportion to its size: paths spell
out their first SPELT levels, and elements below these are never the main slot.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm import exact_dedup
from foliograph.llm.common import materialize
from foliograph.llm.url_filter import host_of

#: Share of a host's pages on which an element of a class stands at least, and on which the skeleton and a template's texts do.
FREQUENT, NEARLY_ALL = 0.02, 0.9
#: Different pages that tell a template's texts from text of the pages.
SUPPORT = 5
#: Share of a class's pages that may break its order or nesting.
BROKEN = 0.02
#: Share of running text that the main slot holds.
MAIN = 0.8
#: Share of a list's or table's text in links from which it is a menu.
LINKED = 0.7
#: Marks don't count where less than this share of running text is unmarked and one marked element holds nearly all.
UNMARKED = 0.1
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>?", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
WHOLE = frozenset("html body main article".split())
#: Elements that show no text of the page.
UNSEEN = frozenset("head script style noscript iframe textarea select template svg canvas object audio video xmp".split())
MARKED_TAGS = frozenset("nav header footer aside form button dialog menu".split())
MARKED_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer bottombar sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent notice notices notification alert gdpr popup modal overlay newsletter subscribe subscription form login signup search comment comments commentlist "
    "reply replies respond disqus social share sharing breadcrumb breadcrumbs pagination pager related recommended widget toolbar contentinfo complementary".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A block of text is in a slot, and never the slot.
BLOCKS = HEADINGS | frozenset("p li dd dt pre blockquote td th figcaption".split())
LISTS = frozenset("ul ol table".split())
#: An open element of the tag closes those of the value that stand open since the nearest list or table.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table".split())


#: Levels whose steps a path spells out, and characters of a step; what is longer or deeper goes on as a hash, so that no page's paths grow with its depth.
SPELT, STEP = 64, 80


class Element:
    """An open element. strong, weak: the deepest marked path it stands in, itself included, by a tag or by a form or class word.

    own: whether all marks around are an article's own headers; self_weak: whether it bears a weak mark itself;
    near_p, near: whether closing a p, or which of CLOSES, can reach one that stands open; chain: hash of its whole ancestry.
    """

    __slots__ = ("chain", "depth", "linked", "near", "near_p", "own", "path", "self_weak", "strong", "tag", "titled", "unseen", "weak")

    def __init__(self, tag: str, above: Element | None, words: list[str]) -> None:
        self.tag = tag
        if above is None:
            self.path, self.chain, self.depth, self.strong, self.weak, self.own = "", 0, 0, "", "", True
            self.unseen = self.linked = self.titled = self.self_weak = self.near_p = False
            self.near = frozenset()
            return
        step = ".".join([tag, *dict.fromkeys(words)])
        hashed = xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), above.chain)
        self.chain, self.depth = hashed, above.depth + 1
        if len(step) > STEP:
            step = f"{tag}.~{hashed:016x}"
        self.path = f"{above.path}/{step}" if self.depth <= SPELT else f"{above.path.partition('/~')[0]}/~{hashed:016x}"
        self.strong, self.weak, self.own, self.self_weak = above.strong, above.weak, above.own, False
        self.titled = above.titled or tag in ("article", "main")
        hit = () if tag in WHOLE else MARKED_WORDS.intersection(words)
        if tag in MARKED_TAGS or hit:
            header = tag == "header" or tag not in MARKED_TAGS and hit == {"header"}
            self.self_weak = tag == "form" or tag not in MARKED_TAGS
            if self.self_weak:
                self.weak = self.path
            else:
                self.strong = self.path
            self.own = above.own and header and above.titled
        elif tag in HEADINGS and self.marked and above.own:  # an article's own header holds its title
            self.strong = self.weak = ""
        self.unseen, self.linked = above.unseen or tag in UNSEEN, above.linked or tag == "a"
        self.near_p = tag == "p" or above.near_p and tag in INLINE
        self.near = (frozenset() if tag in SCOPES else above.near) | ({tag} if tag in CLOSES else frozenset())

    @property
    def marked(self) -> bool:
        return bool(self.strong or self.weak)


def _named(attributes: str) -> list[str]:
    """The words of class, id and role."""
    return [w.lower() for m in NAMES.finditer(attributes) for w in WORDS.findall(m[1] or m[2] or m[3] or "")]


def parts(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open" or "close", element, ""), ("text", element it stands in, text), and ("cut", None, "") where a block starts or ends.

    A tag costs what it opens and closes, however deep it stands: what can't be closed isn't looked for.
    """
    stack, at, find = [Element("", None, [])], 0, TOKEN.search
    standing: Counter[str] = Counter()
    while at < len(page):
        m = find(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield "text", stack[-1], text
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            yield "cut", None, ""
        if m[1]:
            if standing[tag]:
                yield from _closed(stack, standing, lambda e, tag=tag: e.tag == tag)
            continue
        if tag not in INLINE and tag not in VOID and stack[-1].near_p:
            yield from _closed(stack, standing, lambda e: e.tag == "p")
        if tag in CLOSES and not stack[-1].near.isdisjoint(CLOSES[tag]):
            yield from _closed(stack, standing, lambda e, tags=CLOSES[tag]: e.tag in tags)
        element = Element(tag, stack[-1], _named(m[3]) if m[3] else [])
        yield "open", element, ""
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if end and close >= 0 else len(page)
            yield "close", element, ""
        elif tag in VOID or m[3].endswith("/"):
            yield "close", element, ""
        else:
            stack.append(element)
            standing[tag] += 1
    yield from _closed(stack, standing, lambda e: False)


def _closed(stack: list[Element], standing: Counter[str], last: Callable[[Element], bool]) -> Iterator[tuple[str, Element, str]]:
    """Closes elements up to the last one."""
    while len(stack) > 1:
        element = stack.pop()
        standing[element.tag] -= 1
        yield "close", element, ""
        if last(element):
            return


class Token(NamedTuple):
    """Of a page, or summed over a host's pages: path, key (0 for an element, else of the text), pages and times it occurs.

    vector: digest of the times on each page; text: characters in it; linked: of these in links; running: not in links;
    plain: running and unmarked; weak: whether it is marked by a form or class word; first: sum of first places.
    """

    path: str
    key: int
    pages: int
    times: int
    vector: int
    text: int
    linked: int
    plain: int
    weak: bool
    first: int


def text_key(path: str, words: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{words}".encode("utf-8", "surrogatepass"), 7) >> 1 | 1


def token_id(path: str, key: int) -> int:
    return key or text_key(path, "")


def structure(page: str) -> tuple[list[Token], list[int]]:
    """The page's tokens, and its events in order: n where token n opens or a text is, -n-1 where it closes. The first is the page itself."""
    known: dict[tuple[str, int], int] = {("", 0): 0}
    sums, events = [[1, 0, 0, 0, False, 0]], [0]
    open_: list[list[int]] = [[0, 0, 0, 0]]  # token, and what text, linked and plain stand in it so far: carried up when it closes

    def token(path: str, key: int, weak: bool = False) -> int:
        n = known.setdefault((path, key), len(known))
        if n == len(sums):
            sums.append([0, 0, 0, 0, weak, len(events)])
        sums[n][0] += 1
        events.append(n)
        return n

    def closed() -> int:
        n, *held = open_.pop()
        for i, x in enumerate(held, 1):
            sums[n][i] += x
            if open_:
                open_[-1][i] += x
        return -n - 1

    for kind, element, body in parts(page):
        if kind == "open":
            open_.append([token(element.path, 0, element.self_weak), 0, 0, 0])
        elif kind == "close":
            events.append(closed())
        elif kind == "text" and not element.unseen and (words := " ".join(body.split())):
            own = token(element.path, text_key(element.path, words))
            for held in (sums[own], open_[-1]):
                held[1] += len(words)
                if element.linked:
                    held[2] += len(words)
                elif not element.marked:
                    held[3] += len(words)
    events.append(closed())
    return [Token(path, key, 1, times, times, text, linked, plain, weak, first) for (path, key), (times, text, linked, plain, weak, first) in zip(known, sums, strict=True)], events


# classes


def classes(tokens: list[Token]) -> list[list[Token]]:
    """The classes of tokens that share a vector, the best supported first, each in the order of its tokens' first places."""
    found: dict[int, list[Token]] = {}
    for t in tokens:
        found.setdefault(t.vector, []).append(t)
    own = [sorted(c, key=lambda t: (t.first, t.path, t.key)) for c in found.values()]
    return sorted(own, key=lambda c: (-c[0].pages, -len(c), c[0].path, c[0].key))


def order_of(tokens: list[tuple[str, int]]) -> list[int]:
    """The events of one occurrence of a class: n where its token n opens or a text is, -n-1 where it closes."""
    out: list[int] = []
    open_: list[int] = []
    for n, (path, key) in enumerate(tokens):
        while open_ and not (path + "/").startswith(tokens[open_[-1]][0] + "/"):
            out.append(-open_.pop() - 1)
        out.append(n)
        if not key:
            open_.append(n)
    return out + [-n - 1 for n in reversed(open_)]


def fits(events: list[tuple[int, int]], orders: list[list[int]]) -> dict[int, tuple[int, int] | None]:
    """The (class, slot) around each class that a page's (class, event)s keep in order and nested; -1, 0 at the outermost.

    Classes that are out of order are None, and so is the later one of two that cross.
    """
    at, stack = [0] * len(orders), []
    out: dict[int, tuple[int, int] | None] = {}

    def drop(c: int) -> None:
        out[c] = None
        if c in stack:
            stack.remove(c)

    for c, event in events:
        if c in out and out[c] is None:
            continue
        if orders[c][at[c]] != event:
            drop(c)
            continue
        if not at[c]:
            out.setdefault(c, (stack[-1], at[stack[-1]]) if stack else (-1, 0))
            stack.append(c)
        while stack[-1] != c:  # what opened since has not ended
            if stack[-1] < c:
                drop(c)
                break
            drop(stack[-1])
        if out[c] is not None:
            at[c] += 1
            if at[c] == len(orders[c]):
                at[c] = 0
                stack.pop()
    for c in list(stack):
        drop(c)
    return out


@dataclass
class Template:
    """main: path of the main slot; None: no template. menus: paths inside it that are menus; weak: whether weak marks count; texts: keys of the template's texts."""

    main: str | None = None
    menus: list[str] = field(default_factory=list)
    weak: bool = True
    texts: list[int] = field(default_factory=list)


def template(tokens: list[Token], valid: list[list[Token]], nested: dict[int, tuple[int, int]]) -> Template:
    """From a host's frequent tokens, its classes, and the slot that each valid one nests in."""
    pages = max((t.pages for t in tokens), default=0)
    inside = {c for c in nested if _rooted(c, nested)}
    skeleton = [t for c in inside for t in valid[c] if t.pages >= NEARLY_ALL * pages and t.times == t.pages]
    boxes = {t.path: t for t in skeleton if not t.key and "/~" not in t.path}
    if "" not in boxes:
        return Template()
    texts = [t for c in inside for t in valid[c] if t.key]
    whole, weak = boxes[""], True
    running = lambda t: t.text - t.linked
    if whole.plain < UNMARKED * running(whole):
        weak = not any(t.weak and running(t) >= MAIN * running(whole) for t in tokens if not t.key)
    weight = (lambda t: t.plain) if weak else running
    held = {p: weight(t) - sum(weight(x) for x in texts if (x.path + "/").startswith(p + "/")) for p, t in boxes.items()}
    tags = lambda p: [x.partition(".")[0] for x in p.split("/")]
    holding = [p for p in boxes if held[p] >= MAIN * held[""]] if held[""] > 0 else [""]
    named = [p for p in holding if tags(p)[-1] == "article"] or [p for p in holding if tags(p)[-1] == "main"]
    plain = [p for p in holding if not BLOCKS.intersection(tags(p)) and tags(p)[-1] not in INLINE]
    main = max(named or plain or [""], key=lambda p: (p.count("/"), held[p], p))
    if not named:
        main = _with_headings(main, [t for t in tokens if not t.key], boxes, weight)
    within = any(x in ("main", "article") for x in tags(main))
    menus = [] if within else [t.path for t in tokens if not t.key and tags(t.path)[-1] in LISTS and t.text and t.linked >= LINKED * t.text and t.pages > 1]
    return Template(main, sorted(menus), weak, sorted({t.key for t in texts}))


def _rooted(c: int, nested: dict[int, tuple[int, int]]) -> bool:
    """Whether a class and all that it nests in are valid."""
    seen = set()
    while c != -1:
        if c not in nested or c in seen:
            return False
        seen.add(c)
        c = nested[c][0]
    return True


def _with_headings(main: str, elements: list[Token], boxes: dict, weight) -> str:
    """The outermost element around main that adds headings only."""
    best, up, added = main, main, 0
    heads = [t for t in elements if t.path.rpartition("/")[2].partition(".")[0] in HEADINGS]
    while up:
        up = up.rpartition("/")[0]
        if up in boxes:
            more = sum(weight(t) for t in heads if t.path.startswith(up + "/") and not t.path.startswith(main + "/"))
            if weight(boxes[up]) - weight(boxes[main]) > more:
                break
            if more > added:
                best, added = up, more
    return best


def own_template(page: str) -> Template:
    """That of a page by itself."""
    tokens, _ = structure(page)
    elements = [t for t in tokens if not t.key]
    found = classes(elements)
    return template(elements, found, {c: (-1, 0) for c in range(len(found))})


def main_text(page: str, known: Template | None) -> str:
    """What stands in the slots of the page's main slot. A page without it is its own template; without any template all text returns."""
    known = known or Template()
    kept: list[str] = []
    main, found = known.main or "", not known.main
    under, menus, texts = main + "/", tuple(m + "/" for m in known.menus), set(known.texts)
    for kind, element, body in parts(page):
        if kind == "cut":
            kept.append(" ")
        elif kind == "open":
            found = found or element.path == main
        elif kind == "text" and not element.unseen:
            path = element.path + "/"
            if known.main is not None:
                if main and not path.startswith(under) or menus and path.startswith(menus):
                    continue
                if len(element.strong) > len(main) or known.weak and len(element.weak) > len(main):
                    continue
                if texts and text_key(element.path, " ".join(body.split())) in texts:
                    continue
            kept.append(body)
    if not found:
        return main_text(page, own_template(page))
    return " ".join(entities.unescape("".join(kept)).split())


# over hosts

TALLY = "array<struct<id:bigint,path:string,key:bigint,times:int,text:bigint,linked:bigint,plain:bigint,weak:boolean,first:bigint>>"
TOKENS = ("path", "key", "pages", "times", "vector", "text", "linked", "plain", "weak", "first")


def structures(pages: DataFrame) -> DataFrame:
    """host, page (hash of the html), tally (its tokens), events of each of a host's different pages, from host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        names = ("id", "path", "key", "times", "text", "linked", "plain", "weak", "first")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, ends, events = [], [0], []
                for page in part.column(2):
                    tokens, own = structure(page.as_py())
                    rows += [(token_id(t.path, t.key), t.path, t.key, t.times, t.text, t.linked, t.plain, t.weak, t.first) for t in tokens]
                    ends.append(len(rows))
                    events.append(own)
                values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(events, pa.list_(pa.int32()))], ["host", "page", "tally", "events"])

    each = pages.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(run, f"host string, page long, tally {TALLY}, events array<int>")
    each = materialize(each.withColumn("_h", F.xxhash64("host", "page")), "structures")
    # tallies stay where they are; only pages whose hash may repeat meet, those that a Bloom filter of the repeating hashes lets through
    often = exact_dedup.repeated(each.select("_h"), "_h")
    few = exact_dedup.tested(each, "_h", *exact_dedup.filter_of(often, "_h", often.count()))
    once = few.where("_maybe").groupBy("host", "page").agg(F.any_value(F.struct("tally", "events")).alias("s")).select("host", "page", "s.*")
    return few.where("NOT _maybe").select(*once.columns).unionByName(materialize(once, "copies"))


def vectors(pages: DataFrame) -> DataFrame:
    """host and TOKENS of the tokens that a host's template may hold, from its structures. Occurrences combine before the shuffle."""
    each = pages.select("host", "page", F.explode("tally").alias("t")).select("host", "page", "t.*").withColumn("mixed", F.xxhash64("page", "times"))
    half = F.lit(0xFFFFFFFF)
    held = each.groupBy("host", "path", "key").agg(
        F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum(F.col("mixed").bitwiseAND(half)).alias("low"), F.sum(F.shiftrightunsigned("mixed", 32)).alias("high"),
        *[F.sum(c).alias(c) for c in ("text", "linked", "plain")], F.bool_or("weak").alias("weak"), F.sum("first").alias("first"),
    )
    held = held.where(f"key = 0 OR pages >= {SUPPORT}").withColumn("vector", F.xxhash64("low", "high")).select("host", *TOKENS)
    held = materialize(held, "vectors")
    sizes = held.where("path = '' AND key = 0").select("host", F.col("pages").alias("all_pages"))
    return held.join(sizes, "host").where(F.col("pages") >= F.col("all_pages") * F.when(F.col("key") == 0, FREQUENT).otherwise(NEARLY_ALL)).drop("all_pages")


def _tokens(rows: pd.DataFrame) -> list[Token]:
    return [Token(*r) for r in rows[list(TOKENS)].itertuples(index=False, name=None)]


def candidates(frequent: DataFrame) -> DataFrame:
    """host, ids, spots, orders: the tokens of a host's classes by token_id, each with its class and place there, and each class's events.

    Classes are numbered from the best supported.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = classes(_tokens(rows))
        ids = [token_id(t.path, t.key) for own in found for t in own]
        spots = [x for c, own in enumerate(found) for n in range(len(own)) for x in (c, n)]
        orders = [order_of([(t.path, t.key) for t in own]) for own in found]
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "ids": [ids], "spots": [spots], "orders": [orders]})

    return frequent.groupBy("host").applyInPandas(run, "host string, ids array<long>, spots array<int>, orders array<array<int>>")


def by_host(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns of known (host, pages, columns). Hosts with over 1/1000 of all pages, fewer than 1000, are broadcast."""
    total = known.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    often = F.col("pages") > -(-total // 1000)
    hot, cold = F.broadcast(known.where(often).select("host", *columns)), known.where(~often).select("host", *columns)
    return rows.join(hot, "host").unionByName(rows.join(hot.select("host"), "host", "left_anti").join(cold, "host"))


def validated(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, class, outer, slot, pages: on how many pages a class is in order and nests there; outer is null where it doesn't."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    joined = by_host(pages, materialize(found.join(sizes, "host"), "classes"), ["ids", "spots", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[str, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                host, tokens, events, *own = [batch.column(n)[i] for n in range(6)]
                host = host.as_py()
                if host not in recent:
                    if len(recent) == 256:
                        recent.clear()
                    ids, spots, orders = [x.as_py() for x in own]
                    recent[host] = (dict(zip(ids, zip(spots[::2], spots[1::2], strict=True), strict=True)), orders)
                place, orders = recent[host]
                at = [place.get(t) for t in tokens.as_py()]
                own = [(s[0], s[1] if e >= 0 else -s[1] - 1) for e in events.as_py() if (s := at[e if e >= 0 else -e - 1])]
                out += [(host, c, *(around or (None, None))) for c, around in fits(own, orders).items()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([],) * 4, kinds, strict=True)], ["host", "class", "outer", "slot"])

    each = joined.select("host", F.col("tally.id").alias("tokens"), "events", "ids", "spots", "orders")
    return each.mapInArrow(run, "host string, class int, outer int, slot int").groupBy("host", "class", "outer", "slot").agg(F.count("*").alias("pages"))


def nested_in(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """The slot of each valid class, from (class, outer, slot, pages): the one on most pages, if few pages break the class."""
    held: dict[int, dict] = {}
    for c, outer, slot, pages in rows:
        held.setdefault(c, {})[None if outer is None else (outer, slot)] = pages
    good = {c: {k: n for k, n in own.items() if k} for c, own in held.items() if own.get(None, 0) <= BROKEN * sum(own.values())}
    return {c: max(own, key=lambda k: (own[k], (-k[0], -k[1]))) for c, own in good.items() if own}


def templates(pages: DataFrame) -> DataFrame:
    """host, pages, main, menus, weak, texts of each host, from host, html; see Template."""
    each = structures(pages)
    frequent = materialize(vectors(each), "frequent")
    found = materialize(candidates(frequent), "candidates")
    checked = validated(each, found)

    def assemble(rows: pd.DataFrame, nests: pd.DataFrame) -> pd.DataFrame:
        tokens = _tokens(rows)
        some = [(int(c), None if pd.isna(o) else int(o), None if pd.isna(s) else int(s), int(n)) for c, o, s, n in nests[["class", "outer", "slot", "pages"]].itertuples(index=False, name=None)]
        t = template(tokens, classes(tokens), nested_in(some))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "main": [t.main], "menus": [t.menus], "weak": [t.weak], "texts": [t.texts]})

    return frequent.groupBy("host").cogroup(checked.groupBy("host")).applyInPandas(assemble, "host string, main string, menus array<string>, weak boolean, texts array<bigint>")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    Null html is empty and gives an empty text. A page without a host shares one template with all such pages; a host's
    only page is its own template, and so is one without its host's main slot. Long texts are whole. Copies of a page
    count once for the template and return as often as they come; other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    known = templates(rows.select("host", "html")).join(rows.groupBy("host").agg(F.count("*").alias("pages")), "host")
    joined = by_host(rows, materialize(known, "templates"), ["main", "menus", "weak", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page, Template(main, menus, weak, keys)) for page, main, menus, weak, keys in zip(*[part.column(c).to_pylist() for c in ("html", "main", "menus", "weak", "texts")], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "main", "menus", "weak", "texts").mapInArrow(run, "page_id long, url string, text string, n_chars long")
