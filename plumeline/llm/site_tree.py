"""Main text of web pages by site style trees.

The element paths of all pages of a host are merged into one tree. Of each of its nodes Spark counts on how many of the host's pages
it occurs, with which presentation (the children's tags and classes) and with which content. The importance of a content at a node is
one less its entropy over the pages, as a share of the largest: what stands on every page (notices, teasers, lines of the site) has 0,
what one page has alone has 1. A node's presentation importance is the entropy of its presentations. What tag and class say weighs in
as a prior, the more the fewer pages there are. A page loses the branches whose importance is low; what stays is its text. Pages of one
title count as one, so that copies and near copies of an article do not make it look like the site's own words.

What a page marks by itself is not asked of the tree: navigation, forms, scripts, elements whose class, id or role is made of such words
alone ("cookie-banner", "comments", but not "related-work") go, and where a page marks articles, only these are read. Inside them the
tree decides over all blocks but headings; there only what nearly all pages of the host have, EVERYWHERE, can go, so that a passage
that many articles share stays.

Null and empty pages have an empty text. A null url, or one without a host, is of one nameless host. Null keys are kept; repeated rows
give repeated results and count as one page. Pages of any length and depth are read whole, in time that grows with their length. Ties
cannot arise but at a bound, which stays. Further columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

NAME, BREAK, END = re.compile(r"[A-Za-z][^\s/>]*"), re.compile("[>\"']"), {}
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_AT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select", "datalist")}

#: What tag and class say before any page is seen.
NOISE_TAGS = frozenset("nav header footer aside form menu button select dialog head script style noscript template iframe textarea svg math object canvas audio video".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies pagination pager toolbar skip widget".split()
)
#: Words that say nothing beside those.
FILLERS = frozenset("area bar block body bottom box button buttons container content group inner item items left link links list main page panel reader right section site slot text thread title top unit user wrap wrapper".split())
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset("article content main post entry story body text".split())
#: Priors: of what is not said to be anything, of what is inside an article, and of what a part of a name speaks against.
NEUTRAL, INSIDE, DOUBTED = 0.5, 0.8, 0.2
#: Importance below which a branch goes, the pages from which on a host's own counts say more than the prior, and the share of pages that has what may go from an article.
LEAST_IMPORTANCE, PRIOR_PAGES, EVERYWHERE = 0.3, 4.0, 0.8
#: Up to so many low branches (8 bytes each) are broadcast; beyond, pages are joined by host and one of SALTS salts.
BROADCAST_BRANCHES, SALTS = 1_000_000, 64


class Node:
    __slots__ = ("children", "content", "inside", "label", "path", "prior", "tag")

    def __init__(self, tag: str, label: str, path: int, prior: float, inside: bool):
        self.tag, self.label, self.path, self.prior, self.inside, self.children, self.content = tag, label, path, prior, inside, [], 0


def marks_noise(token: str) -> bool | None:
    """Whether a class, id or role is made of noise words (and fillers) alone; None if only a part of it is one."""
    pieces = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
    if NOISE_WORDS.isdisjoint(pieces):
        return False
    return True if all(p in NOISE_WORDS or p in FILLERS for p in pieces) else None


def prior_of(tag: str, attributes: str, parent: Node) -> tuple[str, float]:
    """Label (tag and classes) and prior importance of an element."""
    names: list[str] = []
    noise = doubted = hidden = False
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        value = m[2] or m[3] or m[4] or ""
        kind = m[1].lower()
        if kind in ("class", "id", "role"):
            for token in value.split():
                names.append(token)
                found = marks_noise(token)
                if kind != "id" or tag not in HEADINGS:
                    noise, doubted = noise or found is True, doubted or found is None
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    label = tag + "".join("." + n for n in names[:4])
    if hidden or tag in NOISE_TAGS and not (tag == "header" and parent.inside):
        return label, 0.0
    if tag in ("html", "body"):
        return label, NEUTRAL
    if noise:
        return label, 0.0
    if tag in MAIN_TAGS:
        return label, 1.0
    if doubted and not parent.inside:
        return label, DOUBTED
    if parent.inside or any(n.lower() in MAIN_WORDS for n in names):
        return label, INSIDE
    return label, NEUTRAL


def tag_end(page: str, at: int, closed: dict[str, bool]) -> int:
    """Where a tag's > is; a quote counts where it begins a value and is closed somewhere. -1 if the page ends before."""
    while m := BREAK.search(page, at):
        at, quote = m.end(), m[0]
        if quote == ">":
            return m.start()
        if closed[quote] and page[max(0, m.start() - 64) : m.start()].rstrip().endswith("="):
            close = page.find(quote, at)
            if close < 0:
                closed[quote] = False  # nor is any later one
            else:
                at = close + 1
    return -1


def parse(page: str) -> Node:
    """The element tree; texts are children of type str. Unclosed and stray tags are taken as browsers take them, roughly. Each character is read a bounded number of times."""
    root = Node("#", "#", 0, NEUTRAL, False)
    stack, at, size, closed = [root], 0, len(page), {'"': True, "'": True}
    opened: Counter = Counter()

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    while at < size:
        start = page.find("<", at)
        if start < 0:
            stack[-1].children.append(page[at:])
            break
        following = page[start + 1 : start + 2]
        if not (following.isalpha() and following.isascii() or following in ("/", "!", "?") and following):
            stack[-1].children.append(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].children.append(page[at:start])
        if following in "!?":
            if page.startswith("<!--", start):
                end, skip = page.find("-->", start + 4), 3
            elif page.startswith("<![CDATA[", start):
                end, skip = page.find("]]>", start), 3
                stack[-1].children.append(html.escape(page[start + 9 : end if end >= 0 else size]))
            else:
                end, skip = page.find(">", start), 1
            at = end + skip if end >= 0 else size
            continue
        name = NAME.match(page, start + (2 if following == "/" else 1))
        end = tag_end(page, name.end() if name else start + 2, closed)
        if end < 0:
            break
        at = end + 1
        if not name:
            continue
        tag, attributes = name[0].lower(), page[name.end() : end]
        if following == "/":
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "body", "table", "td") and tag in INLINE:
                    break
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES_SAME and any(opened[t] for t in CLOSES_SAME[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS_AT[tag]:
                    break
                if stack[i].tag in CLOSES_SAME[tag]:
                    close(i)
                    break
        parent = stack[-1]
        label, prior = prior_of(tag, attributes, parent)
        path = parent.path if tag in INLINE or tag == "br" else xxhash.xxh3_64_intdigest(label, parent.path)
        node = Node(tag, label, path, prior, prior > 0 and (parent.inside or tag in MAIN_TAGS))
        parent.children.append(node)
        if tag in RAW:
            ends = END.setdefault(tag, re.compile(f"</{tag}", re.I | re.A)).search(page, at)
            after = page.find(">", ends.end()) if ends else -1
            at = size if after < 0 else after + 1
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def walk(node: Node, enters, begin=None, end=None, text=None) -> None:
    """Depth first: calls begin and end at elements that `enters` allows, and text at their texts. No recursion: pages may be nested deeply."""
    todo: list[tuple[Node | str, bool]] = [(c, True) for c in reversed(node.children)]
    while todo:
        child, begins = todo.pop()
        if isinstance(child, str):
            if text:
                text(child)
        elif not begins:
            if end:
                end(child)
        elif enters(child):
            if begin:
                begin(child)
            todo.append((child, False))
            todo += [(c, True) for c in reversed(child.children)]


def is_block(node: Node) -> bool:
    return node.tag not in INLINE and node.tag != "br"


def set_contents(root: Node) -> None:
    """The content of each element outside noise: a digest of its texts, each without needless white space, made of its children's."""

    def end(node: Node) -> None:
        parts = [xxhash.xxh3_64_intdigest(" ".join(c.split())) if isinstance(c, str) else c.content for c in node.children if not isinstance(c, str) or c.strip()]
        parts = [p for p in parts if p]
        node.content = xxhash.xxh3_64_intdigest(np.array(parts, np.uint64).tobytes()) if parts else 0

    walk(root, lambda c: c.tag not in RAW and c.prior > 0, end=end)


def title_of(page: str) -> str:
    m = re.search(r"<title[^>]*>([^<]*)", page[:100_000], re.I | re.A)
    return " ".join(m[1].split()) if m else ""


def branches(root: Node) -> Iterator[Node]:
    """The elements that may be judged: blocks with a content, but for what is noise by its mark, inside too, and headings of articles."""
    found: list[Node] = []
    walk(root, lambda c: c.tag not in RAW and c.prior > 0, begin=lambda c: found.append(c) if is_block(c) and c.content and not (c.inside and c.tag in HEADINGS) and c.tag not in ("html", "body", *MAIN_TAGS) else None)
    yield from found


def branch_key(node: Node) -> int:
    """Node of the tree and content, as one signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(node.content.to_bytes(8, "little"), node.path)).view(np.int64))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


STYLE = "host string, page long, path long, branch long, presentation long, prior double, inside boolean"


def style_tree(pages: DataFrame) -> DataFrame:
    """host, branch (a content at a node of its tree), importance, n (pages that have it), m (pages that have the node) and inside (an article)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signed = lambda x: int(np.uint64(x).view(np.int64))
        for frame in frames:
            rows = set()
            for host, page in zip(frame["host"], frame["html"], strict=True):
                if not page:
                    continue
                root, name = parse(page), title_of(page)
                set_contents(root)
                name = signed(xxhash.xxh3_64_intdigest(name or page))
                for node in branches(root):
                    looks = xxhash.xxh3_64_intdigest(",".join(c.label for c in node.children if not isinstance(c, str)))
                    rows.add((host, name, signed(node.path), branch_key(node), signed(looks), node.prior, node.inside))
            yield pd.DataFrame(list(rows), columns=["host", "page", "path", "branch", "presentation", "prior", "inside"])

    seen = pages.mapInPandas(run, STYLE).groupBy("host", "path", "branch", "page").agg(F.min("presentation").alias("presentation"), F.min("prior").alias("prior"), F.bool_or("inside").alias("inside"))
    # One row for each branch and page; from here on sums only, which combine before they are shuffled.
    seen = written(seen, "branches")
    contents = seen.groupBy("host", "path", "branch").agg(F.count(F.lit(1)).alias("n"), F.min("prior").alias("prior"), F.bool_or("inside").alias("inside"))
    looks = seen.groupBy("host", "path", "page").agg(F.min("presentation").alias("presentation")).groupBy("host", "path", "presentation").agg(F.count(F.lit(1)).alias("n"))
    largest = F.log2(F.greatest("m", F.lit(2)).cast("double"))
    nodes = looks.groupBy("host", "path").agg(F.sum("n").alias("m"), (F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("same"))
    nodes = nodes.select("host", "path", "m", ((F.log2(F.col("m").cast("double")) - F.col("same")) / largest).alias("presentation"))
    # Only contents of two pages or more can be low.
    both = contents.where("n > 1").join(nodes, ["host", "path"])
    measured = 0.8 * (1 - F.log2(F.col("n").cast("double")) / largest) + 0.2 * F.col("presentation")
    weight = F.col("m") / (F.col("m") + PRIOR_PAGES)
    return both.select("host", "branch", (weight * measured + (1 - weight) * F.col("prior")).alias("importance"), "n", "m", "inside")


def low_branches(tree: DataFrame) -> DataFrame:
    return tree.where((F.col("importance") < LEAST_IMPORTANCE) & (~F.col("inside") | (F.col("n") >= EVERYWHERE * F.col("m"))))


def visible(node: Node, gone: set[int], out: list[str]) -> None:
    """Texts of the branches that stay; a line break before and after each block."""

    def edge(child: Node) -> None:
        if child.tag not in INLINE:
            out.append("\n")

    walk(node, lambda c: c.tag not in RAW and c.prior > 0 and id(c) not in gone, edge, edge, out.append)


def articles_of(node: Node) -> list[Node]:
    """The outermost articles of a page."""
    found: list[Node] = []
    walk(node, lambda c: c.prior > 0 and not (c.tag in MAIN_TAGS and found.append(c) is None))
    return found


def main_text(page: str | None, low: set[int]) -> str:
    """The page's text without branches of low importance; of pages that mark articles, only these."""
    root, out, gone = parse(page or ""), [], set()
    if low:
        set_contents(root)
        gone = {id(n) for n in branches(root) if branch_key(n) in low}
    for node in articles_of(root) or [root]:
        visible(node, gone, out)
        out.append("\n")
    return " ".join(html.unescape("".join(out)).split())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars (its code points) of every page."""
    given = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(F.col(url)).alias("host"))
    lists = written(low_branches(style_tree(given.select("host", "html"))).groupBy("host").agg(F.collect_set("branch").alias("low")), "low-branches")
    if (lists.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_BRANCHES:
        joined = given.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = given.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h, set(p) if p is not None else set()) for h, p in zip(frame["html"], frame["low"], strict=True)]
            yield frame[["key", "url"]].assign(text=texts, n_chars=np.array([len(t) for t in texts], np.int64))

    found = joined.select("key", "url", "html", "low").mapInPandas(run, "key string, url string, text string, n_chars long")
    return found.select(F.col("key").cast(pages.schema[key].dataType).alias(key), F.col("url").alias(url), "text", "n_chars")
