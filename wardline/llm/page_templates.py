"""Main text of web pages by deducing the template that the pages of a host share.

1. A page becomes a sequence of tokens: begins and ends of block elements and whole text blocks, each with the path of elements
   around it (tag, class, id and role; digits alike). A token's occurrence vector says how often each page of the host has it.
   It is kept as sums of hashes of (page, times), so vectors are built by merging and never lie in one place.
2. Tokens of one vector are an equivalence class. A class is frequent if it is in SUPPORT of the host's pages. Hosts with fewer
   than MIN_PAGES pages are taken together.
3. A frequent class is valid if its tokens come in one order on all pages and its cycles nest with those of the other
   classes; classes that cross a more frequent one go. The valid classes, nested, are the template.
4. What is not template lies in slots between its tokens. Slots inside elements that hold menus, notices, adverts, forms and
   the like are not main text. If a host marks its articles, their slots are taken, and what an article says is never
   template, however many pages say it; else the slots of the element that holds most of the host's text outside of links.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardline.llm import common

MIN_PAGES = 5
SUPPORT = 0.5
#: Pages that a Python worker takes apart at once.
PAGES = 64

# HTML elements by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "map", "mark",
    "nobr", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math"}
ASIDE = {"head", "nav", "footer", "aside", "form", "noscript", "button", "select", "option", "fieldset", "dialog", "menu", "object", "canvas", "audio", "video"}
MAIN = {"article", "main"}
#: A new element of the first kind ends an open one of the second, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"}),
}
ASIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "rail",
    "widget", "related", "recommended", "recommendations", "share", "sharing", "social", "footer", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "pagination",
    "pager", "search", "toolbar", "form", "hidden", "contentinfo", "complementary", "dialog", "disclaimer", "copyright",
}
HEADER_WORDS = {"header", "masthead", "banner"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<![-\w])(hidden)(?![-\w])|aria-hidden\s*=\s*["']?(true)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Place:
    """An element's place in the tree of all pages: equal paths are one place."""

    __slots__ = ("aside", "begin", "below", "end", "key", "main", "tag")

    def __init__(self, tag: str, sign: str, words: set[str], above: Place | None):
        self.tag, self.below = tag, {}
        seed = above.key if above else 0
        self.key = xxh64_intdigest(f"{tag} {sign}", seed)
        self.begin, self.end = xxh64_intdigest("<", self.key), xxh64_intdigest(">", self.key)
        inside = bool(above and above.main)
        header = tag == "header" or words & HEADER_WORDS
        self.aside = bool((above and above.aside) or tag in ASIDE or tag in RAW or words & (ASIDE_WORDS - HEADER_WORDS) or (header and not inside))
        self.main = not self.aside and (inside or tag in MAIN or bool(words & MAIN_WORDS))


class Pages:
    """Takes pages apart; places are kept for the next page and forgotten when there are too many."""

    def __init__(self):
        self.root, self.known = Place("", "", set(), None), 0

    def below(self, above: Place, tag: str, attributes: str) -> Place:
        place = above.below.get((tag, attributes))
        if place is None:
            if self.known > 50_000:
                self.root.below, self.known = {}, 0
            named = [next((x for x in m[1:] if x), "") for m in ([m[0], m[2], m[3], m[4]] for m in NAMED.finditer(attributes))]
            named = [n.strip("\"'") for n in named]
            said = named if tag not in ("html", "body") else []
            place = above.below[tag, attributes] = Place(tag, re.sub(r"\d+", "0", " ".join(named)), {w.lower() for n in said for w in WORDS.findall(n)}, above)
            self.known += 1
        return place

    def tokens(self, page: str) -> list[tuple[int, Place, str | None, int]]:
        """(key, place, text of a block or None, characters of it in links) in page order."""
        out: list[tuple[int, Place, str | None, int]] = []
        stack, open_ = [self.root], Counter()
        buffer: list[str] = []
        links = linked = at = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                if text := " ".join("".join(buffer).split()):
                    out.append((xxh64_intdigest(text, stack[-1].key), stack[-1], text, linked))
                buffer.clear()
            linked = 0

        def close() -> None:
            flush()
            place = stack.pop()
            open_[place.tag] -= 1
            out.append((place.end, place, None, 0))

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                buffer.append(piece)
                linked += len(piece) if links else 0

        while m := TAG.search(page, at):
            add(page[at : m.start()])
            at = m.end()
            slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name == "a":
                links = 0 if slash else 1
            if slash:
                if name not in INLINE or open_[name]:
                    flush()
                    while open_[name]:
                        found = stack[-1].tag == name
                        close()
                        if found:
                            break
                continue
            place = None
            if name in INLINE:
                if name == "br":
                    buffer.append(" ")
                if name in VOID or not NAMED.search(rest) or not (place := self.below(stack[-1], name, rest)).aside or stack[-1].aside:
                    continue
            flush()
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
                if not rest.endswith("/"):
                    stop = page.find(">", at)
                    at = len(page) if stop < 0 else stop + 1
                continue
            if place is None and open_["p"] and next(p.tag for p in reversed(stack) if p.tag not in INLINE) == "p":
                while open_["p"] and stack[-1].tag in INLINE:
                    close()
                close()
            if name in ENDS:
                ended, bound = ENDS[name]
                while stack[-1].tag not in bound and any(open_[e] for e in ended):
                    if not any(p.tag in ended for p in upto(stack, bound)):
                        break
                    close()
            stack.append(place or self.below(stack[-1], name, rest))
            open_[name] += 1
            out.append((stack[-1].begin, stack[-1], None, 0))
        add(page[at:])
        flush()
        while len(stack) > 1:
            close()
        return out


def upto(stack: list[Place], bound: set[str]) -> Iterator[Place]:
    for p in reversed(stack):
        if p.tag in bound:
            return
        yield p


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- occurrence vectors --------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, pages, total, v1, v2): how many pages have a token, how often, and two sums of (page, times) hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taker = Pages()
        for b in common.slices(batches, PAGES):
            hosts, keys, times, v1, v2 = [], [], [], [], []
            for host, who, page in zip(*(c.to_pylist() for c in b.columns)):
                for key, n in Counter(t[0] for t in taker.tokens(page)).items():
                    h = xxh64_intdigest(who, n)
                    hosts.append(host), keys.append(signed(key)), times.append(n), v1.append(h & 0x7FFFFFFF), v2.append(h >> 33)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (keys, times, v1, v2))], ["host", "token", "times", "v1", "v2"])

    rows = pages.select("host", "who", "html").mapInArrow(run, "host string, token long, times long, v1 long, v2 long")
    return rows.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("times").alias("total"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))


def candidates(pages: DataFrame, min_pages: int, support: float) -> DataFrame:
    """(host, classes): the frequent classes of every host with enough pages, most frequent first, as [(token, class)];
    host '' has those of all smaller hosts together."""
    hosts = common.stored(pages.groupBy("host").agg(F.count("*").alias("of")), "template-hosts")
    hosts = hosts.withColumn("own", (F.col("of") >= min_pages) & (F.col("host") != ""))
    group = F.when(F.col("own"), F.col("host")).otherwise("").alias("host")
    sizes = hosts.groupBy(group).agg(F.sum("of").alias("of"))
    seen = occurrences(pages).join(hosts.select("host", "own"), "host").where("not own or pages >= " + str(min_pages))
    seen = seen.groupBy(group, "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2")])
    seen = seen.join(sizes, "host").where((F.col("pages") >= F.col("of") * support) & (F.col("pages") >= F.least(F.lit(min_pages), F.col("of"))) & (F.col("pages") > 1))
    named = seen.select("host", "token", F.struct((-F.col("pages")).alias("p"), "total", "v1", "v2").alias("c"))
    return named.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("x")).select("host", F.transform("x", lambda x: F.struct(x["c"].alias("c"), x["token"].alias("token"))).alias("classes"))


def numbered(classes: list) -> dict[int, int]:
    """Token -> number of its class; smaller numbers are more frequent classes."""
    out, last, number = {}, None, -1
    for c in classes or []:
        if c["c"] != last:
            last, number = c["c"], number + 1
        out[c["token"]] = number
    return out


def nested(sequence: list[tuple[int, int]]) -> tuple[dict[int, int], set[int]]:
    """(order hash by class, classes that fail) of the (token, class) sequence of a page.

    A class begins a cycle, goes on token by token and ends it before another cycle of it begins; an open cycle that is not the
    innermost when its class goes on is crossed, and the less frequent of the two fails."""
    order: dict[int, list[int]] = {}
    for token, c in sequence:
        own = order.setdefault(c, [])
        if token not in own:
            own.append(token)
    place = {c: {t: k for k, t in enumerate(o)} for c, o in order.items()}
    failed: set[int] = set()
    stack: list[list[int]] = []
    for token, c in sequence:
        if c in failed:
            continue
        k = place[c][token]
        mine = next((s for s in reversed(stack) if s[0] == c), None)
        if mine is None:
            if k:
                failed.add(c)
                continue
            mine = [c, -1]
            stack.append(mine)
        while stack[-1] is not mine:
            worse = max(stack[-1][0], c)
            failed.add(worse)
            if worse == c:
                break
            stack.pop()
        if c in failed or mine[1] + 1 != k:
            failed.add(c)
            stack.remove(mine)
            continue
        mine[1] = k
        if k == len(place[c]) - 1:
            stack.pop()
    failed |= {s[0] for s in stack}
    return {c: xxh64_intdigest(repr(o)) for c, o in order.items()}, failed


def checked(pages: DataFrame) -> DataFrame:
    """(host, kind, key, ok, first, last, size): kind 0 is a class with what its pages say, kind 1 an element with the size of its
    text outside of links, kind 2 the size of all text in marked articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taker, held = Pages(), {}
        for b in common.slices(batches, PAGES):
            for own, host, classes, page in zip(*(c.to_pylist() for c in b.columns)):
                group, number = host if own else "", numbered(classes)
                tokens = taker.tokens(page)
                orders, failed = nested([(t, number[t]) for t in (signed(x[0]) for x in tokens) if t in number])
                for c, o in orders.items():
                    add(held, (group, 0, c), c not in failed, signed(o), 0)
                for size, place in texts(tokens, number):
                    add(held, (group, 2, 0) if place.main else (group, 1, signed(place.key)), True, 0, size)
            if len(held) > 20_000:
                yield handed(held)
                held = {}
        yield handed(held)

    def texts(tokens: list, number: dict) -> Iterator[tuple[int, Place]]:
        """Text by the element around its block."""
        stack: list[Place] = []
        for key, place, text, linked in tokens:
            if text is None:
                stack.pop() if key == place.end else stack.append(place)
            elif not place.aside and signed(key) not in number:
                yield max(0, len(text) - linked), place if place.main or len(stack) < 2 else stack[-2]

    def add(held: dict, key: tuple, ok: bool, order: int, size: int) -> None:
        was = held.get(key)
        held[key] = (ok, order, order, size) if was is None else (was[0] and ok, min(was[1], order), max(was[2], order), was[3] + size)

    def handed(held: dict) -> pa.RecordBatch:
        rows = [{"host": k[0], "kind": k[1], "key": k[2], "ok": v[0], "first": v[1], "last": v[2], "size": v[3]} for k, v in held.items()]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("host", pa.string()), ("kind", pa.int32()), ("key", pa.int64()), ("ok", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("size", pa.int64())]))

    rows = pages.select("own", "host", "classes", "html").mapInArrow(run, "host string, kind int, key long, ok boolean, first long, last long, size long")
    return rows.groupBy("host", "kind", "key").agg(F.min("ok").alias("ok"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"))


def with_table(pages: DataFrame, by_host: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with the columns of their host's row; hosts without a row get those of the row ''."""
    rest = by_host.where("host = ''").select(*columns).collect()  # one row at most
    own = by_host.where("host <> ''").withColumn("own", F.lit(True))
    joined = pages.join(own, "host", "left")
    kinds = {c: by_host.schema[c].dataType for c in columns}
    shared = {c: F.from_json(F.lit(_json(rest[0][c])), kinds[c]) if rest and isinstance(rest[0][c], list) else F.lit(rest[0][c] if rest else None).cast(kinds[c]) for c in columns}
    return joined.withColumns({c: F.when(F.col("own"), F.col(c)).otherwise(shared[c]) for c in columns}).withColumn("own", F.coalesce("own", F.lit(False)))


def _json(value: list) -> str:
    return json.dumps([v.asDict(recursive=True) if hasattr(v, "asDict") else v for v in value])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, tokens, marked, main): tokens of the valid classes, whether articles are marked, and the element with most text."""
    found = common.stored(candidates(pages, min_pages, support), "template-classes")
    facts = common.stored(checked(with_table(pages, found, ["classes"])), "template-facts")
    valid = facts.where("kind = 0").groupBy("host").agg(F.collect_list(F.when(F.col("ok") & (F.col("first") == F.col("last")), F.col("key"))).alias("valid"))
    places = facts.where("kind > 0").groupBy("host").agg(F.max((F.col("kind") == 2) & (F.col("size") > 0)).alias("marked"), F.max(F.when(F.col("kind") == 1, F.struct("size", "key"))).alias("best"))
    number = F.expr("transform(classes, (c, i) -> size(array_distinct(transform(slice(classes, 1, i + 1), d -> d.c))) - 1)")
    rows = found.select("host", F.transform("classes", lambda c: c["token"]).alias("token"), number.alias("number")).select("host", F.explode(F.arrays_zip("token", "number")).alias("x"))
    kept = rows.join(valid, "host").where("array_contains(valid, cast(x.number as long))").groupBy("host").agg(F.collect_list("x.token").alias("tokens"))
    return common.stored(places.join(kept, "host", "left").select("host", F.coalesce("tokens", F.expr("cast(array() as array<bigint>)")).alias("tokens"), "marked", F.col("best.key").alias("main")), "templates")


# --- extraction ------------------------------------------------------------------------------------


def kept_blocks(tokens: list, template: set[int], marked: bool, main: int | None) -> tuple[list[str], int]:
    """(blocks of the main text, slots they lie in)."""
    blocks, inside, slot = [], [], 0
    for key, place, text, linked in tokens:
        fixed = signed(key) in template and not (marked and text is not None and place.main)
        slot += fixed
        if text is None:
            if key == place.end:
                inside.pop()
            else:
                inside.append(bool(inside and inside[-1]) or signed(place.key) == main)
        elif not place.aside:
            blocks.append((text, slot, fixed, place.main, bool(inside and inside[-1]), 2 * linked > len(text)))
    taken = [b for b in blocks if b[3]] if marked else []
    taken = taken or [b for b in blocks if b[4] and not b[5]] or [b for b in blocks if not b[5]]
    # A page whose main text is template for the greater part is one of many copies, and keeps it.
    if 2 * sum(len(b[0]) for b in taken if b[2]) < sum(len(b[0]) for b in taken):
        taken = [b for b in taken if not b[2]]
    return [b[0] for b in taken], len({b[1] for b in taken})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_slots): the main text of every page, blocks joined by line ends.

    Null or empty pages, and pages without main text, have an empty text; a null or odd url counts as a host of few pages;
    repeated rows are pages of their own; of elements with equally much text the one with the largest key is taken; pages are
    read whole; other columns are ignored; an empty table gives an empty table.
    """
    who = F.concat_ws(" ", F.col(id_col).cast("string"), F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), who.alias("who"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = with_table(rows, templates(rows, min_pages, support), ["tokens", "marked", "main"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taker = Pages()
        for b in common.slices(batches, PAGES):
            made, slots = [], []
            for page, tokens, marked, main in zip(*(b.column(c).to_pylist() for c in ("html", "tokens", "marked", "main"))):
                blocks, n = kept_blocks(taker.tokens(page), set(tokens or ()), bool(marked), main)
                made.append(blocks), slots.append(n)
            texts = ["\n".join(x) for x in made]
            sizes = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [len(x) for x in made], slots)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *sizes], ["page_id", "url", "text", "n_chars", "n_blocks", "n_slots"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return found.select("page_id", "url", "html", "tokens", "marked", "main").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_slots long")
