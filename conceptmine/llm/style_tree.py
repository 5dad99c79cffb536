"""Main text of pages by a site style tree.

The DOMs of a host are merged: elements with the same chain of tags and presentation
names are one node of the tree; names that are rare on the host, as a page's own, count as
none. Two entropies over the host's distinct pages decide about
the text that stands directly in a node, computed with plain aggregations:

* content: how much text a page has there that other pages do not have (a block on all
  pages counts nothing, a block on one page counts in full; one such block a page is enough);
* presentation: how evenly the sequences of child elements are spread (a menu always looks
  alike, an article does not), of the node, or of the one above if it has no elements.

Content times a half to one for presentation is the node's importance. Names that speak against
an article's text halve it, once for each element on the branch; they count nothing on html,
body, main and article, nor on a branch that has most of the host's unique text. Names of reader
comments count twice, and are spared only where hardly any unique text stands elsewhere. A host with few
pages leans on the tree of all hosts. Text in nodes
of low importance is cut from each page; on pages that have an ``article`` or ``main``, text
beside it needs a higher one, and text inside it that at most half the host's pages share stays. A low node
takes nothing with it that stands in nodes below
it, so repeated blocks, however many, never cost a page its own text. Pages of a host that
differ only in short blocks are one page of its tree, as an article on two URLs is; a page that
would lose all text of its article keeps the article's long blocks.
Tags that never hold an article's text (scripts, menus, forms, ...) and elements that their
attributes hide have the factor 0.

Defined results: a null or empty page has an empty text; pages with equal ids are done
one by one; equal pages of a host count once in its tree; a null or odd url is a host of
its own; broken markup is read like a browser does in the cases that occur (elements
left open, text cut off anywhere); an empty table gives no rows; further columns are
never read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import vec
from conceptmine.llm.keyset import KeySet, key_set
from conceptmine.session import materialize

#: Text below the first importance goes; beside an article or main, below the second.
LEAST, LEAST_BESIDE = 0.3, 0.6
#: Factor of every element with a name that speaks against an article's text. It is a prior only: it lowers the
#: importance of the text below, and not at all where a branch has more than this share of its host's unique text.
NAMED, MOST = 0.5, 0.5
#: Pages of all hosts' tree that count like the host's own.
LEAN = 20
#: Characters of a long block, and a page, on the average, of the unique text beside which reader comments are such.
LONG, ELSEWHERE = 40, 80
#: Share of a host's pages that may have a block in common inside an article.
SHARED = 0.5
#: Names on fewer than two of a host's pages, or on fewer than one in so many, are left out of its tree.
RARE = 100
#: Common names that are broadcast as bits. With more of them every page is joined with its own list.
MOST_COMMON = 4_000_000
#: Telling elements above a block, of each kind, that are told; so many that are not spared make it go, and where one is spared
#: those above it are, too, as they hold at least as much.
MOST_NAMED = 8
#: Slices of a (host, node) in the join with the pages' blocks.
SALTS = 16

# Tags of the HTML standard, by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NOISE = frozenset("head nav footer aside form button select noscript template svg canvas audio video object dialog menu math".split())
BLOCKS = frozenset(
    "html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address hr fieldset details summary center hgroup search".split())
ARTICLE = frozenset(("article", "main"))
#: Names of these say nothing about their text: of the page, or of what it is there for.
PLAIN = ARTICLE | {"html", "body"}
#: A start tag of these closes an open one of the given kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
_LISTS = frozenset(("table", "ul", "ol", "dl"))
_LISTED = _LISTS | {c for closed in CLOSES.values() for c in closed}
#: Words in class, id and role that speak against an article's text.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement adverts banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup login sidebar side menu nav navigation navbar breadcrumb breadcrumbs "
    "toolbar footer masthead header share sharing social related recommended comment comments reply replies discussion respond "
    "widget search pagination pager skip disclaimer".split())

#: Those of reader comments.
TALK = frozenset("comment comments reply replies discussion respond".split())

_TAG = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _unsigned(x: int) -> int:
    return x & _MASK


def _text_hash(text: str) -> int:
    """A stable 64-bit hash of a short text."""
    import hashlib
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_STYLES: dict[str, tuple[int, int, float, bool]] = {}


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _hidden(have: dict[str, str]) -> bool:
    """Whether the attributes themselves hide the element; ``hidden`` as a word elsewhere does not."""
    return ("hidden" in have and have["hidden"].strip().lower() != "until-found"
            or have.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(have.get("style", ""))))


def _style(tag: str, attributes: str) -> tuple[int, int, float, bool]:
    """Numbers of an element's presentation, by tag and names without digits and by tag alone, its factor, and whether it names comments."""
    key = f"{tag} {attributes}"
    have = _STYLES.get(key)
    if have is None:
        given = _attributes(attributes)
        names = [re.sub(r"\d+", "#", given[k].lower()) for k in ("class", "id", "role") if given.get(k)]
        words = {w for n in names for w in re.split(r"[^a-z]+", n) if w}
        factor = 0.0 if tag in NOISE or tag != "html" and tag != "body" and _hidden(given) else (
            NAMED if tag not in PLAIN and words & NOISE_NAMES else 1.0)
        # without its names an element still differs from one whose names do not speak against it
        bare = tag if factor != NAMED else f"{tag} !"
        have = _text_hash(" ".join([tag, *sorted(names)]) if names else tag), _text_hash(bare), factor, not TALK.isdisjoint(words)
        if len(_STYLES) > 100_000:
            _STYLES.clear()
        _STYLES[key] = have
    return have


class Common:
    """Which presentations with names are common on their host, exactly, for all that occur in the pages.

    Every level has the bits of those that the level before tells wrongly: the first one common names, the
    second one the others that pass for common, and so on. The last level tells none wrongly.
    """

    PROBES = 4

    def __init__(self, levels: list[KeySet]):
        self.levels, self.known = levels, {}

    @staticmethod
    def pair(host: int, style: int) -> int:
        return (host * 0x9E3779B97F4A7C15 + style) & _MASK

    @classmethod
    def probes(cls, pairs: np.ndarray) -> np.ndarray:
        return np.concatenate([vec.scramble(pairs + np.uint64(i)) for i in range(1, cls.PROBES + 1)]).view(np.int64)

    @classmethod
    def maybe(cls, level: KeySet, pairs: np.ndarray) -> np.ndarray:
        return level.maybe(cls.probes(pairs)).reshape(cls.PROBES, -1).all(axis=0)

    def has(self, host: int, style: int) -> bool:
        pair = self.pair(host, style)
        found = self.known.get(pair)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            one = np.array([pair], np.uint64)
            passed = next((i for i, level in enumerate(self.levels) if not self.maybe(level, one)[0]), len(self.levels))
            found = self.known[pair] = passed % 2 == 1
        return found


class Block(NamedTuple):
    """A block of text: the node it stands in, the one above, whether inside an article, telling nodes above it by kind."""

    leaf: int
    up: int | None
    text: str
    inside: bool
    named: tuple[int, ...]
    talk: tuple[int, ...]


class _Open(NamedTuple):
    """An open element. ``kept`` is false in a branch of factor 0; ``listed`` is the place of the nearest part of a list or table."""

    tag: str
    node: int
    up: int | None
    kept: bool
    inside: bool
    named: tuple[int, ...]
    talk: tuple[int, ...]
    listed: int


def parse(page: str, common: Callable[[int], bool] | None = None, seen: set[int] | None = None) -> tuple[list[Block], dict[int, int]]:
    """Text blocks, and child sequences by node, in time that grows with the page.

    Text in a branch of factor 0 is left out. Names that are not common on the host count as none;
    presentations with names are added to ``seen``.
    """
    blocks: list[Block] = []
    nodes: dict[int, int] = {}
    stack = [_Open("", 0, None, True, False, (), (), 0)]
    opened: dict[str, int] = {}
    text: list[str] = []

    def flush() -> None:
        joined = "".join(text)
        text.clear()
        if "&" in joined:
            joined = entities.unescape(joined)
        joined = " ".join(joined.split())
        top = stack[-1]
        if joined and top.kept:
            blocks.append(Block(top.node, top.up, joined, top.inside, top.named, top.talk))

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS or tag in NOISE:
                if opened.get(tag):
                    flush()
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    close(k)
                elif tag == "p":
                    flush()
            continue
        if tag in RAW:
            raw_end = _CLOSE[tag].search(page, at)
            if raw_end is None:
                break
            at = page.find(">", raw_end.end()) + 1 or end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in NOISE:
            continue
        flush()
        if tag == "hr":
            continue
        if stack[-1].tag == "p":  # an open p is always the innermost element
            close(len(stack) - 1)
        closes = CLOSES.get(tag, ())
        k = stack[-1].listed if any(opened.get(c) for c in closes) else 0
        while k > 0:
            if stack[k].tag in closes:
                close(k)
                if stack[-1].tag not in closes:
                    break
            elif stack[k].tag in _LISTS:
                break
            k = stack[k - 1].listed
        style, bare, factor, talks = _style(tag, m[3])
        if style != bare:
            if seen is not None:
                seen.add(style)
            if common is not None and not common(style):
                style = bare
        above = stack[-1]
        if tag == "header" and not above.inside:
            factor = 0.0
        node = _signed((above.node * 0x9E3779B97F4A7C15 + style) ^ (style >> 7))
        if above.node in nodes:
            nodes[above.node] = (nodes[above.node] * 0xD6E8FEB86659FD93 + style) & _MASK
        nodes.setdefault(node, 1)
        named, talk = above.named, above.talk
        if 0 < factor < 1 and talks:
            talk = (talk + (node,))[-MOST_NAMED:]
        elif 0 < factor < 1:
            named = (named + (node,))[-MOST_NAMED:]
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Open(tag, node, above.node if len(stack) > 1 else None, above.kept and factor > 0,
                           above.inside or tag in ARTICLE and factor > 0, named, talk, len(stack) if tag in _LISTED else above.listed))
    flush()
    return blocks, {n: _signed(s) for n, s in nodes.items()}


def _main_key(blocks: list[Block], copy: int) -> int:
    """The same number for pages with the same long blocks without telling names, if these are half the text; else ``copy``."""
    long = {b.text for b in blocks if len(b.text) >= LONG and not b.named and not b.talk}
    if not long or 2 * sum(map(len, long)) < sum(len(b.text) for b in blocks):
        return copy
    return _signed(_text_hash("\n".join(sorted(long))))


def _parsed(pages: DataFrame, with_text: bool, common: Common | DataFrame) -> DataFrame:
    """Every page's blocks with their texts, or what the tree needs of it: hashes of the blocks, and the nodes.

    ``pages`` has ``host``, ``copy`` (hash of the html), and ``_html`` as its last column.
    """
    context = pages.sparkSession.sparkContext
    bits = None if isinstance(common, DataFrame) else context.broadcast(common)
    given = pages.columns[:-1]
    if bits is None:  # every page with the list of its own common names
        pages = pages.join(common, ["host", "copy"], "left").select(*given, "_styles", "_html")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in given)
    block = [("leaf", pa.int64()), ("text", pa.string()), ("beside", pa.bool_()), ("inside", pa.bool_()), ("spare", pa.bool_())] if with_text else [
        ("leaf", pa.int64()), ("up", pa.int64()), ("hash", pa.int64()), ("chars", pa.int64()),
        ("named", pa.list_(pa.int64())), ("talk", pa.list_(pa.int64()))]
    style = pa.list_(pa.struct([("node", pa.int64()), ("children", pa.int64())]))

    def names(part: pa.RecordBatch) -> Iterator[Callable[[int], bool]]:
        if bits is None:
            for own in part.column("_styles").to_pylist():
                yield {_unsigned(style) for style in own or ()}.__contains__
        else:
            for host in map(_text_hash, part.column("host").to_pylist()):
                yield lambda style, host=host: bits.value.has(host, style)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                page, styles, keys = [], [], []
                for text, copy, has in zip(part.column("_html").to_pylist(), part.column("copy").to_pylist(), names(part)):
                    blocks, nodes = parse(text or "", has)
                    if with_text:
                        article = any(b.inside for b in blocks)
                        page.append([{"leaf": b.leaf, "text": b.text, "beside": article and not b.inside, "inside": b.inside,
                                      "spare": b.inside and len(b.text) >= LONG and not b.named and not b.talk} for b in blocks])
                    else:
                        page.append([{"leaf": b.leaf, "up": b.up, "hash": _signed(_text_hash(b.text)), "chars": len(b.text),
                                      "named": b.named, "talk": b.talk} for b in blocks])
                        styles.append([{"node": n, "children": c} for n, c in nodes.items()])
                        keys.append(_main_key(blocks, copy))
                out = [*(part.column(c) for c in given), pa.array(page, pa.list_(pa.struct(block)))]
                if with_text:
                    yield pa.RecordBatch.from_arrays(out, [*given, "page"])
                else:
                    yield pa.RecordBatch.from_arrays([*out, pa.array(styles, style), pa.array(keys, pa.int64())], [*given, "page", "styles", "main"])

    schema = "page array<struct<leaf: long, text: string, beside: boolean, inside: boolean, spare: boolean>>" if with_text else (
        "page array<struct<leaf: long, up: long, hash: long, chars: long, named: array<long>, talk: array<long>>>, "
        "styles array<struct<node: long, children: long>>, main long")
    return pages.mapInArrow(run, f"{kinds}, {schema}")


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host")


def common_names(pages: DataFrame, url: str = "url", html: str = "html") -> Common | DataFrame:
    """The presentations that enough of their host's distinct pages have; all of them on a host with one page.

    Up to ``MOST_COMMON`` come as bits to broadcast, more as a written table of each page's own. Both are exact.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                lists = []
                for text, host in zip(part.column(2).to_pylist(), part.column(0).to_pylist()):
                    seen: set[int] = set()
                    parse(text or "", seen=seen)
                    key = _text_hash(host)
                    lists.append([{"pair": _signed(Common.pair(key, s)), "style": s} for s in map(_signed, seen)])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lists, kind)], ["host", "copy", "pairs"])

    kind = pa.list_(pa.struct([("pair", pa.int64()), ("style", pa.int64())]))
    rows = pages.select(_host(url), F.xxhash64(html).alias("copy"), F.col(html).alias("_html"))
    rows = rows.mapInArrow(run, "host string, copy long, pairs array<struct<pair: long, style: long>>")
    rows = materialize(rows.dropDuplicates(["host", "copy"]))
    sizes = materialize(rows.groupBy("host").agg(F.count("*").alias("m")))
    n, m = F.col("n"), F.col("m")
    counts = rows.select("host", F.explode("pairs.pair").alias("pair")).groupBy("host", "pair").agg(F.count("*").alias("n"))
    told = materialize(counts.join(sizes, "host").select("pair", ((m == 1) | (n > 1) & (n * RARE >= m)).alias("common")))
    often = told.where("common").select("pair")
    if often.count() > MOST_COMMON:
        own = rows.select("host", "copy", F.explode("pairs").alias("p")).select("host", "copy", "p.*").join(often, "pair", "left_semi")
        # no longer than a page's names are
        return materialize(own.groupBy("host", "copy").agg(F.collect_list("style").alias("_styles")))
    return Common(_levels(often, told.where("not common").select("pair")))


def _levels(right: DataFrame, wrong: DataFrame) -> list[KeySet]:
    """Bits of the pairs in ``right``, then of those in ``wrong`` that pass for such, and so on by turns until none does."""
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Common.probes(batch.column(0).to_numpy().view(np.uint64)))], ["k"])

    def passing(level: KeySet) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        bits = right.sparkSession.sparkContext.broadcast(level)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(Common.maybe(bits.value, batch.column(0).to_numpy().view(np.uint64))))
        return run

    levels = []
    while not right.isEmpty():
        levels.append(key_set(materialize(right.mapInArrow(probes, "k long")), "k"))
        right, wrong = materialize(wrong.mapInArrow(passing(levels[-1]), "pair long")), right
    return levels


def importance(pages: DataFrame, common: Common | DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host``, ``node``, ``importance`` of the nodes that have text of their own, and ``shared``: whether most pages of the host
    have a block of it, or telling names stand above it.

    By the entropies of the host's tree and of the tree of all hosts.
    """
    rows = _parsed(pages.select(_host(url), F.xxhash64(html).alias("copy"), F.col(html).alias("_html")), False, common)
    rows = materialize(rows.groupBy("host", "main").agg(F.min_by(F.struct("page", "styles"), "copy").alias("p")).select("host", "p.*"))
    looks = rows.select("host", F.explode("styles").alias("s")).groupBy("host", "s.node", "s.children").agg(F.count("*").alias("k"))
    # a block that stands more than once on a page counts once
    blocks = rows.select("host", F.explode(F.array_distinct("page")).alias("b")).select("host", "b.*")
    texts = materialize(blocks.groupBy("host", "leaf", "up", "hash", "chars", "named", "talk").agg(F.count("*").alias("k")))
    k, m = F.col("k"), F.col("m")

    def by_leaf(texts: DataFrame, *by: str) -> DataFrame:
        size = F.col("chars") * k
        return texts.groupBy(*by, "leaf", "up", "named", "talk").agg(F.sum("k").alias("n"), F.sum(k * F.log(k)).alias("text"), F.max("k").alias("most"),
                                                             F.sum(size).alias("size"), F.sum(size * F.log(k)).alias("same"))

    # telling names count nothing where most of the host's unique text is
    own = materialize(by_leaf(texts, "host"))
    sizes = materialize(rows.groupBy("host").agg(F.count("*").alias("m")))
    unique = F.when(m > 1, F.col("size") - F.col("same") / F.log(m)).otherwise(F.col("size").cast("double"))
    telling = F.explode(F.concat(*[F.transform(kind, lambda n: F.struct(n.alias("node"), F.lit(kind == "talk").alias("talks")))
                                   for kind in ("named", "talk")]))
    amounts = own.join(sizes, "host").select("host", "leaf", "named", "talk", "m", unique.alias("amount"))
    total = amounts.groupBy("host").agg(F.sum("amount").alias("all"))
    elsewhere = F.col("all") - F.col("amount") < ELSEWHERE * m
    most = amounts.select("host", "amount", "m", telling.alias("t")).groupBy("host", "t.node", "t.talks").agg(
        F.sum("amount").alias("amount"), F.first("m").alias("m")).join(total, "host").where(
        (F.col("amount") > MOST * F.col("all")) & (~F.col("talks") | elsewhere)).select("host", "node")
    named = own.where(F.size("named") + F.size("talk") > 0).select("host", "leaf", telling.alias("t")).select("host", "leaf", "t.*")
    against = named.join(most, ["host", "node"], "left_anti").groupBy("host", "leaf").agg(
        F.sum(F.when(F.col("talks"), 2).otherwise(1)).alias("against"))

    def scores(looks: DataFrame, texts: DataFrame, *by: str) -> DataFrame:
        look = looks.groupBy(*by, "node").agg(
            F.sum("k").alias("m"), F.sum(k * F.log(k)).alias("look"), F.max(F.col("children") != 1).alias("parted"))
        look = look.select(*by, "node", "m", "parted", F.when(m > 1, 1 - F.col("look") / (m * F.log(m))).alias("look"))
        news = F.when(m > 1, F.col("n") - F.col("text") / F.log(m)).otherwise(F.col("n").cast("double"))
        text = texts.withColumnRenamed("leaf", "node").join(look, [*by, "node"]).withColumn("text", F.least(news / m, F.lit(1.0)))
        above = look.select(*by, F.col("node").alias("up"), F.col("m").alias("up_m"), F.col("look").alias("up_look"))
        look = F.when(F.col("parted") | F.col("up_m").isNull(), F.col("look")).otherwise(F.col("up_look"))
        return text.join(above, [*by, "up"], "left").select(*by, "node", "m", "most", "text", look.alias("look"))

    all_hosts = scores(looks.groupBy("node", "children").agg(F.sum("k").alias("k")),
                       by_leaf(texts.groupBy("leaf", "up", "hash", "chars", "named", "talk").agg(F.sum("k").alias("k"))))
    both = scores(looks, own, "host").join(
        all_hosts.select("node", F.col("m").alias("all_m"), F.col("text").alias("all_text"), F.col("look").alias("all_look")), "node").join(
        against.withColumnRenamed("leaf", "node"), ["host", "node"], "left").withColumn("against", F.coalesce("against", F.lit(0)))
    both = both.join(sizes.withColumnRenamed("m", "pages"), "host")
    # the look of a single page says nothing: it counts for a text unless its names speak against it
    unknown = F.when(F.col("against") > 0, 0.0).otherwise(1.0)
    i = F.col("text") * (1 + F.coalesce("look", unknown)) / 2
    all_i = F.col("all_text") * (1 + F.coalesce("all_look", unknown)) / 2
    lean = F.least("all_m", F.lit(LEAN))
    mixed = (m * i + lean * all_i) / (m + lean)
    return both.select("host", "node", (F.pow(F.lit(NAMED), F.col("against")) * mixed).alias("importance"),
                       ((F.col("against") > 0) | (F.col("most") > SHARED * F.col("pages"))).alias("shared"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    Html never moves: pages are parsed once for the names, once for the tree and once for their texts.
    Blocks meet the written rows (host, node) of what is cut, which Spark broadcasts if their size
    allows and joins in slices otherwise, and are put together again by page.
    """
    common = common_names(pages, url, html)
    weak = importance(pages, common, url, html).where(F.col("importance") < LEAST_BESIDE)
    weak = materialize(weak.select("host", "node", (F.col("importance") < LEAST).alias("low"), "shared",
                                   F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_slice")))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.xxhash64(html).alias("copy"), F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        _host(url), F.col(html).alias("_html"))
    blocks = _parsed(rows, True, common).select("_row", "page_id", "url", "host", F.posexplode_outer("page").alias("at", "b")).select(
        "_row", "page_id", "url", "host", "at", "b.text", "b.beside", "b.inside", "b.spare", F.col("b.leaf").alias("node"),
        F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("_slice"))
    gone = F.coalesce(F.col("beside") | F.col("low") & (~F.col("inside") | F.col("shared")), F.lit(False)) & F.col("low").isNotNull()
    kept = F.when(F.col("at").isNotNull() & (~gone | F.col("spare")), F.struct("at", "text", gone.alias("gone")))
    whole = blocks.join(weak, ["host", "node", "_slice"], "left").groupBy("_row").agg(
        F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.sort_array(F.collect_list(kept)).alias("page"))
    # only where nothing of an article is left do its long blocks stay
    left = F.filter("page", lambda b: ~b["gone"])
    text = F.array_join(F.transform(F.when(F.exists("page", lambda b: ~b["gone"]), left).otherwise(F.col("page")), lambda b: b["text"]), "\n\n")
    return whole.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
