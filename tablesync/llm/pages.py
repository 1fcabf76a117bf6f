"""Main text of web pages by equivalence-class template deduction (operator 2).

A page's tokens are its tags and its words, both in context: a tag with its class and id, below the
tags around it, and a word within the text between two tags. Words of one such run of text always
stand together, so a run is kept as one token that counts as its words. Over all pages of a host, a
token has an occurrence vector: how often it stands on each page. Tokens of one host with the same
vector and within the same outer class form an equivalence class. A class is valid if it is frequent
(three pages or more; words also on half of the host's pages) and large (two tags or words or more).
Valid classes, nested in each other, are the host's template: its tags frame slots, its words are
text that is the same from page to page. What is left is the text of the slots.

The content slot is chosen by the text that varies over the host's pages and is no link. Template tags
that hold other blocks and half of that text may be it: the outermost that directly holds a varying
heading; else the outermost whose own blocks hold a tenth of it; else the innermost. Within it, blocks
made of template words alone are left out, and template blocks whose text is links (lists of other
stories). So are menus, headers, footers, side bars, notices, adverts, forms, scripts, styles
and reader comments that say so by tag, role or name. A host has no template if it has too few pages, or
if the content slot holds more text that stays than text that varies (copies of one page); there, and
on a page without its host's content slot, the page's own ``article``, ``main`` or body is taken.

Scale: an occurrence vector is kept as the exclusive or of a hash of (page, count), so vectors come
from a combining aggregate and a host with a third of all pages is not gathered; a task hands its sums
on whenever they are many. Classes and nesting are joins over frequent tokens, by pointer jumping up the
tree. Pages are walked three times: for vectors, for what the slots hold, for the text. A host's
template (a few numbers) joins its pages, as a broadcast if it is counted to be small; html is
shuffled only if it is not.

Defined cases: null or empty html: empty text; null url: a host of its own name, the empty one;
markup that does not close: an open tag ends with its parent, and a paragraph with the next block; a
``<`` that starts no tag is text; repeated rows are each returned, and cancel out in vectors without
harm; content slots that tie: all of them are content; empty table: no rows; other columns
are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.functions.sizing import broadcast_if_small
from tablesync.llm.common import map_texts
from tablesync.workspace import written

#: Fewest pages of a template token, fewest tags and words of a class; share of a host's pages that its words need.
MIN_PAGES, MIN_TOKENS, WORD_PAGES = 3, 2, 0.5

#: Shares: of a host's varying text in its content slot, of it in the slot's own blocks, of links in a list of links.
MOST_TEXT, OWN_TEXT, LINKS = 0.5, 0.1, 0.8

#: Sums that a task holds before it hands them on.
HELD = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A tag that ends an open one of the same group, up to the tag that may hold several.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "option": (("option",), ("select",)), "tr": (("tr",), ("table", "tbody", "thead", "tfoot"))}
ENDS |= dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))) | dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table")))

DROP_TAGS = frozenset("head nav header footer aside form button select menu dialog canvas object audio video".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice popup promo related replies reply respond share "
    "sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
KEEP_WORDS = frozenset("article body content entry main post story text title".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
_ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_MASK = (1 << 64) - 1


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text.strip(" /\t\n") else {}


def dropped(tag: str, attrs: dict[str, str]) -> bool:
    """Does this tag hold something other than content?"""
    if tag in DROP_TAGS:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in DROP_ROLES:
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & DROP_WORDS and not words & KEEP_WORDS:
            return True
    return False


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An open tag: its key (hash of its context), the tag around it, its block, and whether it holds dropped things or a link."""

    __slots__ = ("tag", "key", "up", "depth", "drop", "link", "block", "home")

    def __init__(self, tag: str, key: int, up: Node | None, drop: bool):
        self.tag, self.key, self.up, self.drop = tag, key, up, drop
        self.depth = up.depth + 1 if up else 0
        self.link = tag == "a" or (up is not None and up.link)
        self.block = tag in BLOCKS and tag not in VOID
        self.home = self if self.block or up is None else up.home


ROOT = Node("", 0, None, False)


def run_key(node: Node, text: str) -> int:
    """The token of a run of words below a tag."""
    return xxhash.xxh64_intdigest("\0" + " ".join(text.split()), node.key) >> 1


#: What may stand in a head; any other tag ends it.
HEAD = frozenset("base link meta noscript script style template title".split())


def walk(page: str) -> Iterator[tuple[str, Node | None, str]]:
    """Events in page order: ``open`` (tag's node), ``text`` (innermost node, raw text) and ``break`` (a block ends)."""
    stack, at = [ROOT], 0
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            yield "break", None, ""
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCKS and tag != "br":
            ends, within = ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in ends:
                    del stack[i:]
                    if not ends:
                        break
                elif stack[i].tag in within or (not ends and stack[i].tag in BLOCKS):
                    break
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        attrs = attributes(m[3])
        top = stack[-1]
        key = xxhash.xxh64_intdigest(f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}", top.key) >> 1
        node = Node(tag, key, top, top.drop or dropped(tag, attrs))
        yield "open", node, ""
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if at < len(page):
        yield "text", stack[-1], page[at:]


def _mixed(page: int, count: int) -> int:
    x = (page * 0x9E3779B97F4A7C15 + count * 0xC2B2AE3D27D4EB4F) & _MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 29)) - (1 << 63)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_TOKENS = pa.schema(
    [("host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("words", pa.int32())]
    + [("plain", pa.bool_()), ("dropped", pa.bool_()), ("vector", pa.int64()), ("pages", pa.int64())]
)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, host and token: what it is, the vector of its pages, and how many they are.

    ``words`` is 0 for a tag; ``plain`` is true for a block that is no heading.
    """
    sums: dict[tuple[str, int], list] = {}

    def rows() -> pa.RecordBatch:
        out = _batch([(host, key, *s) for (host, key), s in sums.items()], _TOKENS)
        sums.clear()
        return out

    for batch in batches:
        for host, page, html in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("html"), strict=True):
            counts: dict[int, list] = {}
            for kind, node, text in walk(html.as_py()):
                if kind == "open":
                    known = counts.get(node.key)
                    if known:
                        known[0] += 1
                    else:
                        counts[node.key] = [1, node.up.key, node.depth, 0, node.block and node.tag not in HEADINGS, node.drop]
                elif kind == "text" and not node.drop and (words := len(text.split())):
                    counts.setdefault(run_key(node, text), [0, node.key, node.depth + 1, words, False, False])[0] += 1
            for key, (n, *what) in counts.items():
                own = sums.setdefault((host, key), [*what, 0, 0])
                own[-2] ^= _mixed(page, n)
                own[-1] += 1
            if len(sums) > HELD:
                yield rows()
    if sums:
        yield rows()


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    page = F.xxhash64(F.col("page_id").cast("string"), "url", "html")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(host, F.lit("")).alias("host"), page.alias("page"), F.coalesce("html", F.lit("")).alias("html"))


def deduced(pages: DataFrame) -> DataFrame:
    """Every host's template: ``host``, ``token``, ``parent``, ``depth``, ``words`` (0: a tag), ``plain``, ``dropped``, ``class_id``."""
    schema = "host string, token long, parent long, depth int, words int, plain boolean, dropped boolean, vector long, pages long"
    rows = map_texts(_rows(pages).select("host", "page", "html"), _occurrences, schema)
    # all but the host is of fixed width, so the aggregate hashes; a token's own columns are all alike
    same = [F.max(c).alias(c) for c in ("parent", "depth", "words", "plain", "dropped")]
    tokens = rows.groupBy("host", "token").agg(*same, F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"))
    frequent = written(tokens.where(F.col("pages") >= MIN_PAGES), "page-tokens")
    hosts = frequent.groupBy("host").agg(F.max(F.when(F.col("words") == 0, F.col("pages"))).alias("of"))
    enough = (F.col("words") == 0) | (F.col("pages") >= WORD_PAGES * F.col("of"))
    frequent = written(frequent.join(hosts, "host").where(enough).drop("of", "pages"), "page-frequent")

    # a token of its parent's vector belongs to the parent's class; a top token's class lies in its parent's
    around = frequent.select("host", F.col("token").alias("parent"), F.col("vector").alias("around"))
    inner = F.coalesce(F.col("around") == F.col("vector"), F.lit(False))
    nests = frequent.join(around, ["host", "parent"], "left").select(
        "host", "token", F.when(inner, F.col("parent")).otherwise(F.col("token")).alias("top"), F.when(~inner, F.coalesce("around", F.lit(0))).alias("outer")
    )
    nests = written(nests, "page-nests")
    deepest = frequent.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):  # each round doubles the way up
        above = nests.select("host", F.col("token").alias("top"), F.col("top").alias("next"), F.col("outer").alias("its"))
        nests = written(nests.join(above, ["host", "top"]).select("host", "token", F.col("next").alias("top"), F.coalesce("outer", "its").alias("outer")), "page-nests")
    classed = frequent.join(nests, ["host", "token"]).withColumn("class_id", F.xxhash64("vector", "outer"))
    size = F.sum(F.when(F.col("words") == 0, 1).otherwise(F.col("words")))
    valid = classed.groupBy("host", "class_id").agg(size.alias("size")).where(F.col("size") >= MIN_TOKENS)
    kept = classed.join(valid.select("host", "class_id"), ["host", "class_id"], "left_semi")
    return written(kept.select("host", "token", "parent", "depth", "words", "plain", "dropped", "class_id"), "page-templates")


def templates(pages: DataFrame) -> DataFrame:
    """The tags of every host's template; columns as in :func:`deduced`."""
    return deduced(pages).where("words = 0")


_HELD = pa.schema(
    [("host", pa.string()), ("token", pa.int64()), ("chars", pa.int64()), ("varying", pa.int64()), ("links", pa.int64())]
    + [("own", pa.int64()), ("holds", pa.bool_()), ("title", pa.bool_())]
)


def _holdings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, host and tag: the text below it, that which varies, links, that of its own blocks; holds it blocks, a varying heading?"""
    sums: dict[tuple[str, int], list] = {}

    def rows() -> pa.RecordBatch:
        out = _batch([(host, key, *s) for (host, key), s in sums.items()], _HELD)
        sums.clear()
        return out

    for batch in batches:
        for host, html, words in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("words").to_pylist(), strict=True):
            template = set(words)

            def held(node: Node, host: str = host) -> list:
                known = sums.get((host, node.key))
                if known is None:
                    known = sums[host, node.key] = [0, 0, 0, 0, False, False]
                return known

            for kind, node, text in walk(html.as_py()):
                if kind == "open" and node.block:
                    held(node.up.home)[4] = True
                elif kind == "text" and not node.drop and text.strip():
                    n, varies, home = len(text), not node.link and run_key(node, text) not in template, node.home
                    if varies:
                        held(home)[3] += n
                        if home.up:
                            outer = held(home.up.home)
                            outer[3] += n
                            outer[5] |= home.tag in ("h1", "h2")
                    link = node.link
                    while node.up:  # text of all tags that hold it
                        sum_ = held(node)
                        sum_[0] += n
                        sum_[1] += n if varies else 0
                        sum_[2] += n if link else 0
                        node = node.up
            if len(sums) > HELD:
                yield rows()
    if sums:
        yield rows()


def content(pages: DataFrame, template: DataFrame) -> DataFrame:
    """Per host with a template: ``slots``, the tokens that hold its content, ``outside``, those in them that do not, and its ``words``."""
    words = template.groupBy("host").agg(F.collect_set(F.when(F.col("words") > 0, F.col("token"))).alias("words"))
    words = written(words, "page-words")
    rows = _rows(pages).join(broadcast_if_small(words), "host").select("host", "html", "words")
    schema = "host string, token long, chars long, varying long, links long, own long, holds boolean, title boolean"
    sums = [F.sum(c).alias(c) for c in ("chars", "varying", "links", "own")] + [F.max(c).alias(c) for c in ("holds", "title")]
    held = map_texts(rows, _holdings, schema).groupBy("host", "token").agg(*sums)
    tags = written(template.where("words = 0 and not dropped").join(held, ["host", "token"]), "page-slots")
    tags = tags.join(tags.groupBy("host").agg(F.max("varying").alias("most")), "host")
    most = F.col("varying") >= MOST_TEXT * F.col("most")
    level = F.when(F.col("title"), 2).when(F.col("own") >= OWN_TEXT * F.col("most"), 1).otherwise(0)
    rank = level * (1 << 40) + F.when(level > 0, (1 << 36) - F.col("depth")).otherwise(F.col("depth"))
    ranked = tags.where((F.col("varying") > 0) & F.col("holds") & most).withColumn("rank", rank.cast("long"))
    chosen = ranked.join(ranked.groupBy("host").agg(F.max("rank").alias("best")), "host").where("rank = best")
    slots = chosen.groupBy("host").agg(
        F.sort_array(F.collect_set("token")).alias("slots"), F.sum("varying").alias("varies"), F.sum(F.col("chars") - F.col("links")).alias("text")
    )
    slots = slots.where(F.col("varies") * 2 >= F.col("text")).select("host", "slots")
    lists = tags.where(F.col("plain") & ~most & (F.col("chars") > 0) & (F.col("links") >= LINKS * F.col("chars")))
    lists = lists.groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("outside"))
    return slots.join(lists, "host", "left").join(words, "host")


def main_text(page: str, slots: list[int] | None = None, outside: list[int] | None = None, words: list[int] | None = None) -> str:
    """The text of the slots, without the tags outside of them and blocks of template words (all given as token keys).

    Else that of the page's ``article``, ``main`` or body; a line per block.
    """
    found: dict[str, list[str]] = {"slots": [], "article": [], "main": [], "body": []}
    wanted, left_out, template = set(slots or ()), set(outside or ()), set(words or ())
    inside: dict[int, frozenset] = {0: frozenset()}
    block: list[str] = []
    where: frozenset = frozenset()
    varies = False

    def close() -> None:
        nonlocal varies
        if block:
            raw = "".join(block)
            line = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            block.clear()
            if line:
                found["body"].append(line)
                for name in where:
                    if name != "slots" or varies:
                        found[name].append(line)
        varies = False

    for kind, node, text in walk(page):
        if kind == "break":
            close()
        elif kind == "open":
            within = inside.get(node.up.key, frozenset())
            if node.tag in ("article", "main"):
                within |= {node.tag}
            if node.key in wanted:
                within |= {"slots"}
            elif node.key in left_out:
                within -= {"slots"}
            inside[node.key] = within
        elif not node.drop:
            if not block:
                where = inside.get(node.key, frozenset())
            elif where != inside.get(node.key, frozenset()):
                close()
                where = inside.get(node.key, frozenset())
            block.append(text)
            if not varies and text.strip():
                varies = not template or run_key(node, text) not in template
    close()
    return "\n".join(found["slots"] or found["article"] or found["main"] or found["body"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = zip(batch.column("html"), *(batch.column(c).to_pylist() for c in ("slots", "outside", "words")), strict=True)
        texts = [main_text(h.as_py(), *template) for h, *template in given]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (empty if none), ``n_chars`` (code points)."""
    slots = written(content(pages, deduced(pages)), "page-content")
    rows = _rows(pages).join(broadcast_if_small(slots), "host", "left").select("page_id", "url", "html", "slots", "outside", "words")
    return map_texts(rows, _extracted, "page_id long, url string, text string, n_chars long")
