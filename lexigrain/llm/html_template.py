"""Main text of web pages: a template per host from equivalence classes of tokens, and its slots."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import bound_batches, query, spread, table
from lexigrain.llm.url_filter import parts
from lexigrain.session import persisted

#: A class is valid when so many tokens share its occurrence vector, on pages with so many texts.
LEAST_TOKENS, LEAST_TEXTS = 2, 3

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Element kinds of HTML. (Fixed values.)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp "
    "rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
SCOPES = set("ul ol dl table select".split())
#: Elements, roles and words of class or id that never hold the article.
OUTSIDE = set(
    "head script style noscript template nav footer aside form iframe object embed svg canvas "
    "button select textarea input option dialog menu title audio video map xmp".split()
)
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside widget widgets related recommended share "
    "sharing social comment comments respond reply replies discussion disqus footer subscribe "
    "newsletter signup login search form pagination pager toolbar copyright hidden".split()
)
HEADER_WORDS = set("header masthead topbar".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


@dataclass
class Node:
    """An open element: its name, the hash of its path, and what is known of its place."""

    tag: str
    path: int
    depth: int
    outside: bool
    article: int
    label: str = ""


@dataclass
class Block:
    """A piece of text between block borders."""

    path: list[Node]
    texts: list[str] = field(default_factory=list)
    linked: int = 0


def _open(tag: str, attributes: dict[str, str], parent: Node) -> Node:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = set(re.findall(r"[a-z]+", names.lower()))
    role = attributes.get("role", "").lower()
    article = 0
    if tag == "main" or role == "main":
        article = 1
    if tag == "article" or role == "article":
        article = 2
    if attributes.get("itemprop", "").lower() == "articlebody":
        article = 3
    article = max(article, parent.article)
    header = tag == "header" or bool(words & HEADER_WORDS)
    outside = (
        parent.outside
        or tag in OUTSIDE
        or role in OUTSIDE_ROLES
        or (tag not in ("html", "body") and bool(words & OUTSIDE_WORDS))
        or "hidden" in attributes
        or (header and not article)
    )
    label = tag + "".join(f".{w}" for w in sorted(words))
    digest = xxhash.xxh64_intdigest(f"{parent.path}/{label}".encode("utf-8", "replace")) >> 1
    return Node(tag, digest, parent.depth + 1, outside, article, label)


def blocks_of(page: object) -> tuple[list[Block], list[Node]]:
    """Text blocks of a whole page in order, and all its block elements.

    Elements that are never closed end with their parent; end tags without a start are ignored.
    Text of scripts and the like is skipped up to their end tag, so markup inside it is no markup.
    """
    if not isinstance(page, str):
        return [], []
    stack = [Node("", 0, 0, False, 0)]
    shapes = [stack[0]]  # the block elements among the open ones
    blocks, nodes, now, links, at = [], [], Block([stack[0]]), 0, 0

    def border() -> None:
        nonlocal now
        if now.texts:
            blocks.append(now)
        now = Block(list(shapes))

    def put(text: str) -> None:
        if text:
            now.texts.append(text)
            now.linked += len(text) if links else 0

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            gone = stack.pop()
            if gone.tag == "a":
                links -= 1
            if shapes[-1] is gone:
                border()
                shapes.pop()
                border()

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            break
        mark = MARK.match(page, start)
        if mark is None:
            put(page[at : start + 1])
            at = start + 1
            continue
        put(page[at:start])
        at = mark.end()
        if mark[2] is None:
            continue
        tag = mark[2].lower()
        if mark[1]:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if found and not (tag in INLINE and any(n.tag in SCOPES for n in stack[found + 1 :])):
                close(found)
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            ends = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                elif stack[i].tag in SCOPES and "p" not in ends:
                    break
        if tag == "br":
            put(" ")
        if tag in VOID:
            if tag not in INLINE:
                border()
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
        node = _open(tag, _attributes(mark[3]), shapes[-1]) if tag not in INLINE else Node(tag, 0, 0, False, 0)
        if tag == "a":
            links += 1
        stack.append(node)
        if tag not in INLINE:
            border()
            shapes.append(node)
            nodes.append(node)
            border()
    put(page[at:])
    border()
    return blocks, nodes


def clean(texts: list[str]) -> str:
    return " ".join(html.unescape("".join(texts)).split())


TOKENS = "host string, page long, text long, path long, parent long, label string, depth int, n int, own long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """A row per page and distinct token: an element with its path of tags, classes and ids.

    ``n`` is the token's entry in the page's occurrence vector, ``own`` a hash of the text in its slot,
    which is what no deeper token holds (0 if there is none), and ``text`` one of the page's whole text.
    """

    def hashed(words: str, before: int) -> int:
        return xxhash.xxh64_intdigest(words.encode("utf-8", "replace"), before & (2**64 - 1)) >> 1

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, text in zip(batch["host"], batch["page"], batch["html"]):
                blocks, nodes = blocks_of(text)
                own: dict[int, int] = {}
                whole = 0
                for block in blocks:
                    words = clean(block.texts)
                    if words:
                        path = block.path[-1].path
                        own[path] = hashed(words, own.get(path, 0)) or 1
                        whole = hashed(words, whole)
                seen: dict[int, list] = {}
                parents = {0: 0}
                trail: list[Node] = []
                for node in nodes:
                    while trail and trail[-1].depth >= node.depth:
                        trail.pop()
                    parents[node.path] = trail[-1].path if trail else 0
                    trail.append(node)
                    seen.setdefault(node.path, [node, 0])[1] += 1
                for path, (node, n) in seen.items():
                    rows.append((host, page, whole, path, parents[path], node.label, node.depth, n, own.get(path, 0)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])

    return pages.mapInPandas(counted, TOKENS)


def deduce(tokens: DataFrame) -> DataFrame:
    """The template of each host: its tokens with their class, the class around it, and the kind of slot.

    Tokens are in one class when their occurrence vectors over all pages of the host are equal: the
    vectors are compared by number of pages, an exclusive or and a sum over hashes of page and entry,
    so no vector is ever put together and every page counts. A layout's tokens are on its pages only, so each
    layout has classes of its own. A class is valid with enough tokens, on pages of enough different
    texts. Valid classes nest: ``around`` is the class of the element that holds the class's first
    token, null at the top and where layouts share no more than that element. A slot is ``fixed`` when its
    text is the same wherever its token occurs.
    """
    entry = F.xxhash64("page", "n")
    vectors = tokens.groupBy("host", "path").agg(
        F.min("parent").alias("parent"), F.min("label").alias("label"), F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("pages"), F.bit_xor(entry).alias("mixed"),
        F.sum(F.shiftrightunsigned(entry, 32)).alias("added"),
        # one bit of 64 for each text: never more than there are different texts
        F.bit_count(F.expr("bit_or(shiftleft(1L, cast(pmod(text, 64) AS int)))")).alias("texts"),
        ((F.min("own") == F.max("own")) & (F.min("own") != 0)).alias("fixed"),
    )
    vector = ["host", "pages", "mixed", "added"]
    frequent = vectors.filter(F.col("texts") >= LEAST_TEXTS)
    classes = frequent.groupBy(*vector).agg(
        F.count(F.lit(1)).alias("tokens"), F.min(F.struct("depth", "path", "parent")).alias("top")
    )
    named = classes.filter(F.col("tokens") >= LEAST_TOKENS).select(
        *vector, F.col("top.path").alias("class"), F.col("top.parent").alias("holder")
    )
    template = persisted(frequent.join(named, vector).drop("mixed", "added"), "template-tokens")
    holders = template.select("host", F.col("path").alias("holder"), F.col("class").alias("around"))
    return template.join(holders, ["host", "holder"], "left")


def fixed_slots(template: DataFrame) -> DataFrame:
    """``host, fixed``: tokens whose slot holds text of the template."""
    return template.filter("fixed").groupBy("host").agg(F.collect_set("path").alias("fixed"))


def main_text(page: object, fixed: Iterable[int]) -> str:
    """Text of the slots of a page that hold its article.

    What lies in menus, forms, adverts, comments and the like is left out. A page that marks its article
    by an element gives the slots in it, and nothing beside it. Others give all slots. Text of an element outside
    the template belongs to the slot around it and stays; what stands in a fixed slot is the template's.
    """
    inside = [b for b in blocks_of(page)[0] if not b.path[-1].outside]
    best = max((b.path[-1].article for b in inside), default=0)
    fixed = set(fixed)
    kept = [b for b in inside if b.path[-1].article == best and b.path[-1].path not in fixed]
    texts = [clean(b.texts) for b in kept]
    return "\n".join(t for t in texts if t)


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    A template is deduced per host from the occurrence vectors of its pages' elements, see
    :func:`deduce`; text that it fixes is taken away, and what the remaining slots hold is the article, see
    :func:`main_text`. A page is cut into blocks, character references are decoded, and white space
    is made one blank. Hosts with too few different pages for a template fix nothing.

    Null and empty pages give an empty text. Pages without a host form one group. Repeated rows and
    copies of a page count as one text, so what only they share is never taken for a template, and give a row each; a null id stays null. Only three columns are read. Tokens
    combine per host before the shuffle, so a host with a third of all pages is no large group; a
    host's template has a row, which pages meet in a join that can be split.
    """
    bound_batches(pages.sparkSession)
    host, _ = parts(F.col(url))
    rows = spread(
        pages,
        [F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
         host.alias("host"), F.xxhash64(F.col(page_id), F.col(url), F.col(html)).alias("page")],
    )
    tokens = persisted(page_tokens(rows.select("host", "page", "html")), "page-tokens")
    slots = persisted(fixed_slots(deduce(tokens)), "slots")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, fixed in batches:
            yield pd.Series([main_text(t, f) for t, f in zip(texts, fixed)])

    found = rows.join(slots, "host", "left").select(
        "page_id", "url", text_of("html", F.coalesce("fixed", F.array().cast("array<bigint>"))).alias("text")
    )
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
