"""Main text of web pages by wrapper induction on the pages of a host.

A page is read into a tree of block elements. What its markup already names as furniture
(menus, forms, scripts, notices) is left out there. The trees of pages of one host are
aligned one after another with the wrapper so far, by simple tree matching: of two
nodes with one label, the children are matched in order so that most nodes pair up.
Unmatched nodes join the wrapper. A text that a wrapper node shows on nearly all pages,
or on nearly all pages of one layout, is template; texts that vary are content. The main
text is the content of the article or that around it, whichever is more.

A host's pages are dealt by hash into chunks of bounded size and each chunk induces its
own wrapper, so a host with a third of all pages is spread over many tasks. Pages cross
the shuffle once, read and compressed.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Pages that induce a wrapper together, on average.
CHUNK = 64
#: A text is template if a wrapper node has it on this share of the pages, provided that
#: this share of them, and so many at least, differ in some other node. Pages that have
#: such a node in common are a layout, and are judged like all pages.
SHARE, DIFFER, PAGES = 0.8, 0.5, 4
#: Sibling pairs beyond which children are matched by whole rows of pairs, to the same result.
CELLS = 250_000
#: Deeper elements count as children of the last level.
DEPTH = 60
#: Hosts up to which their counts are broadcast.
BROADCAST_HOSTS = 200_000

#: Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body"}

#: Elements, roles and words in classes or ids that name furniture.
FURNITURE = set(
    "head nav aside footer form menu button select input label fieldset dialog template svg math"
    " object audio video canvas map datalist search".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo"
    " promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments"
    " disqus respond replies share sharing social related recommended recommendations newsletter"
    " subscribe subscription signup login widget widgets toolbar pagination pager skip".split()
)
#: Those that hold what others wrote or other pages' teasers, articles as they may be.
FOREIGN = set("comment comments disqus respond replies related recommended recommendations".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[a-z]+")
INTRODUCES = re.compile(r"(?:p|h[1-6]|hgroup)(?:\.|\Z)")


def _furniture(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """1 to 3 for an element that may be furniture; its class for the label.

    1 is by its tag; 2 by its role, as hidden or as foreign; 3 by another word that is a
    whole class or id, which holds unless the element turns out to have the main text.
    """
    if tag in FURNITURE or (tag == "header" and not in_article):
        return 1, ""
    words, kind = "", 0
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = "".join(values).lower(), name.lower()
        if name == "role":
            if value in ROLES:
                return 2, ""
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value == "true":
                return 2, ""
        elif name in ("class", "id"):
            whole = value.split()
            if tag not in ("html", "body", "main"):
                if not FOREIGN.isdisjoint(whole):
                    return 2, ""
                if not WORDS.isdisjoint(whole) or ("header" in whole and not in_article):
                    kind = 3
            words += "." + ".".join(NAME.findall(value))
    return kind, words


def read(source: str | None) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """(nodes, blocks) of a page: (depth, label) in page order; (node, in article, text)."""
    source = source or ""
    nodes: list[tuple[int, str]] = [(0, "")]
    blocks: list[tuple[int, int, str]] = []
    # tag, node, left out (1: for its tag, 2: for its words), articles around, text kept back
    stack: list[tuple[str, int, int, int, list[str] | None]] = [("", 0, 0, 0, None)]
    pending: list[str] = []
    # doubtful elements, by node: the last block and node before them, and those within
    doubts: list[list[int]] = []
    open_doubts: dict[int, int] = {}

    def flush() -> None:
        _, node, dropped, articles, _ = stack[-1]
        if pending and not dropped:
            text = " ".join(entities.unescape("".join(pending)).split())
            if text:
                blocks.append((node, articles, text))
        pending.clear()

    def close(least: int) -> None:
        while len(stack) > least:
            kept = stack[-1][4]
            if kept is None:
                flush()
            else:  # an inline element left out: the text around it goes on
                pending[:] = [*kept, " "]
            stack.pop()
            doubt = open_doubts.pop(len(stack), None)
            if doubt is not None:
                doubts[doubt][1:3] = [len(nodes), len(blocks)]

    at, size, lower = 0, len(source), None
    while at < size:
        found = TAG.search(source, at)
        if not found:
            pending.append(source[at:])
            break
        if found.start() > at:
            pending.append(source[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        large = tag in BLOCK or tag in FURNITURE
        if tag == "br":
            pending.append(" ")
        elif found[1]:
            if large:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
            elif stack[-1][0] == tag:
                close(len(stack) - 1)
        elif tag in RAW:
            lower = source.lower() if lower is None else lower
            end = (lower if len(lower) == size else source).find("</" + tag, at)
            at = size if end < 0 else end
        elif tag == "hr":
            flush()
        elif tag in VOID:
            continue
        elif not large:
            _, node, dropped, articles, _ = stack[-1]
            inner = stack[-1][0] == tag
            if inner or (found[3] and not dropped and _furniture(tag, found[3], articles > 0)[0]):
                stack.append((tag, node, 2, articles, list(pending)))
                pending.clear()
        else:
            # elements that the new one ends by itself
            if stack[-1][0] == "p" and tag in BLOCK or stack[-1][0] == "head" and tag != "head":
                close(len(stack) - 1)
            for i in range(len(stack) - 1, 0, -1) if tag in ENDS else ():
                if stack[i][0] in ENDS[tag]:
                    close(i)
                elif stack[i][0] in SCOPE:
                    break
            flush()
            _, parent, dropped, articles, _ = stack[-1]
            words = ""
            if dropped == 1 and tag in ("article", "main"):
                dropped = 0
            if not dropped:
                dropped, words = _furniture(tag, found[3], articles > 0)
            articles += tag in ("article", "main")
            if tag in ("article", "main") and dropped in (0, 3):
                for doubt in open_doubts.values():
                    doubts[doubt][4] = 1
            if dropped == 3:
                open_doubts[len(stack)] = len(doubts)
                doubts.append([len(nodes), 0, 0, len(blocks), int(tag == "article")])
                dropped = 0
            if not dropped:
                nodes.append((min(nodes[parent][0] + 1, DEPTH), tag + words))
                parent = len(nodes) - 1
            stack.append((tag, parent, dropped, articles, None))
    close(1)
    flush()
    return _settle(nodes, blocks, doubts)


def _settle(
    nodes: list[tuple[int, str]], blocks: list[tuple[int, int, str]], doubts: list[list[int]]
) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Leave out doubtful elements but those with an article or more than half of the text.

    A doubt is (first node, node after, block after, first block, whether it has an article).
    """
    if not doubts:
        return nodes, blocks
    sums = [0]
    for _, _, text in blocks:
        sums.append(sums[-1] + len(text))
    gone_nodes, gone_blocks = bytearray(len(nodes)), bytearray(len(blocks))
    reached = 0
    for node, after, last, first, article in doubts:
        if node >= reached and not article and 2 * (sums[last] - sums[first]) <= sums[-1]:
            gone_nodes[node:after] = b"\1" * (after - node)
            gone_blocks[first:last] = b"\1" * (last - first)
            reached = after
    places, kept = [], 0
    for gone in gone_nodes:
        places.append(kept)
        kept += not gone
    return (
        [n for n, gone in zip(nodes, gone_nodes, strict=True) if not gone],
        [(places[at], i, t) for (at, i, t), gone in zip(blocks, gone_blocks, strict=True) if not gone],
    )


class Node:
    """A block element, or a run of alike neighbours; `texts` are numbers of blocks."""

    __slots__ = ("label", "children", "texts", "form", "seen", "pages")

    def __init__(self, label: str):
        self.label = label
        self.children: list[Node] = []
        self.texts: list[int] = []
        self.form = 0
        self.seen: Counter[int] = Counter()
        self.pages: dict[int, int] = {}


def _absorb(node: Node, twin: Node) -> None:
    """Put a neighbour of the same form into a run."""
    node.texts += twin.texts
    for a, b in zip(node.children, twin.children, strict=True):
        _absorb(a, b)


def _fold(node: Node) -> None:
    """Turn runs of neighbours of one form into one node each, from the leaves up."""
    folded: list[Node] = []
    for child in node.children:
        _fold(child)
        if folded and folded[-1].form == child.form:
            _absorb(folded[-1], child)
        else:
            folded.append(child)
    node.children = folded
    node.form = hash((node.label, *[c.form for c in folded]))


def tree(nodes: list[tuple[int, str]], blocks: list[tuple[int, int, str]]) -> Node:
    made = [Node(label) for _, label in nodes]
    path: list[Node] = []
    for (depth, _), node in zip(nodes, made, strict=True):
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    for number, (at, _, _) in enumerate(blocks):
        made[at].texts.append(number)
    _fold(made[0])
    return made[0]


def matching(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the most pairs of nodes that labels and order allow."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        above = [0] * (len(b.children) + 1)
        for x in a.children:
            row = [0]
            for j, y in enumerate(b.children, 1):
                row.append(max(above[j], row[-1], above[j - 1] + matching(x, y, memo)))
            above = row
        memo[key] = above[-1] + 1
    return memo[key]


def _pairs(a: list[Node], b: list[Node], memo: dict) -> list[tuple[int, int]]:
    """Which children are matched, in order."""
    if [x.form for x in a] == [y.form for y in b]:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > CELLS:
        return _pairs_by_rows(a, b, memo)
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i][j] = max(
                score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + matching(x, y, memo)
            )
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _pairs_by_rows(a: list[Node], b: list[Node], memo: dict) -> list[tuple[int, int]]:
    """As `_pairs`, a row of scores at a time; what is kept of a pair is two bits."""
    labels: dict[str, int] = {}
    kinds = np.array([labels.setdefault(y.label, len(labels)) for y in b])
    places = {label: np.flatnonzero(kinds == kind) for label, kind in labels.items()}
    deep = {label: [j for j in own.tolist() if b[j].children] for label, own in places.items()}
    above, steps = np.zeros(len(b) + 1, dtype=np.int64), []
    for x in a:
        worth = np.zeros(len(b), dtype=np.int64)
        if x.label in places:
            worth[places[x.label]] = 1  # two of one label, one of them without children
            for j in deep[x.label] if x.children else ():
                worth[j] = matching(x, b[j], memo)
        row = np.zeros_like(above)
        row[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + worth))
        steps.append((np.packbits(row[1:] == above[1:]), np.packbits(row[1:] == row[:-1])))
        above = row

    def bit(bits: np.ndarray, at: int) -> int:
        return bits[at >> 3] >> (7 - (at & 7)) & 1

    pairs, i, j = [], len(a), len(b)
    while i and j:
        up, left = steps[i - 1]
        if bit(up, j - 1):
            i -= 1
        elif bit(left, j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def align(wrapper: Node, page: Node, owner: dict[int, Node]) -> None:
    """Grow the wrapper by a page; `owner` gets the wrapper node of each block."""
    memo: dict[tuple[int, int], int] = {}
    todo = [(wrapper, page)]
    while todo:
        known, node = todo.pop()
        owner.update(dict.fromkeys(node.texts, known))
        pairs = _pairs(known.children, node.children, memo) if known.children else []
        matched = {j: known.children[i] for i, j in pairs}
        grown, i = [], 0
        for j, child in enumerate(node.children):
            if j in matched:
                while known.children[i] is not matched[j]:
                    grown.append(known.children[i])
                    i += 1
                i += 1
                target = matched[j]
            else:
                target = Node(child.label)
                target.form = child.form
            grown.append(target)
            todo.append((target, child))
        known.children = grown + known.children[i:]


def main_texts(pages: list[tuple[list, list]]) -> list[str]:
    """The main text of each of some pages of a host, given as read."""
    wrapper, owners = Node(""), []
    slots: dict[int, tuple[Node, list[int]]] = {}
    for nodes, blocks in pages:
        owner: dict[int, Node] = {}
        align(wrapper, tree(nodes, blocks), owner)
        shown: dict[int, set[int]] = {}
        for i, (_, _, text) in enumerate(blocks):
            shown.setdefault(id(owner[i]), set()).add(hash(text))
            slots.setdefault(id(owner[i]), (owner[i], [0]))
        bit = 1 << len(owners)
        for at, found in shown.items():
            node, count = slots[at]
            node.seen.update(found)
            for text in found:
                node.pages[text] = node.pages.get(text, 0) | bit
            count[0] |= bit
        owners.append(owner)
    # pages differ as far as some slot does; copies of a page differ nowhere
    everything, layouts, widest = (1 << len(pages)) - 1, set(), 0.0
    for node, (shown_on,) in slots.values():
        n = shown_on.bit_count()
        differ = n * len(node.seen) / node.seen.total()
        widest = max(widest, differ)
        if differ >= max(PAGES, DIFFER * n):
            layouts.add(shown_on)
    if widest >= max(PAGES, DIFFER * len(pages)):
        layouts.add(everything)
    template = {
        (at, text)
        for at, (node, _) in slots.items()
        for text, on in node.pages.items()
        if on.bit_count() >= SHARE * PAGES
        and any((on & of).bit_count() >= SHARE * of.bit_count() for of in layouts)
    }
    texts = []
    for (nodes, blocks), owner in zip(pages, owners, strict=True):
        varying = [
            (inside, t, at) for i, (at, inside, t) in enumerate(blocks) if (id(owner[i]), hash(t)) not in template
        ]
        within = sum(len(t) for inside, t, _ in varying if inside)
        around = sum(len(t) for inside, t, _ in varying if not inside)
        if around > within:
            chosen = [t for inside, t, _ in varying if not inside]
        else:
            # headings and paragraphs right before the article introduce it
            first = next((i for i, (inside, _, _) in enumerate(varying) if inside), 0)
            lead = first
            while lead and INTRODUCES.match(nodes[varying[lead - 1][2]][1]):
                lead -= 1
            chosen = [t for i, (inside, t, _) in enumerate(varying) if inside or lead <= i < first]
        texts.append("\n\n".join(chosen))
    return texts


def host(url: Column) -> Column:
    """The host of an address in lower case, empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages read and compressed; equal rows of a batch travel once, with their number."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        batch["n"] = batch.groupby("order")["order"].transform("size")
        batch = batch.drop_duplicates("order").copy()
        batch["page"] = [
            squeeze.compress(json.dumps(read(h), ensure_ascii=False, separators=(",", ":")).encode())
            for h in batch.pop("html")
        ]
        yield batch


def _extract(group: pd.DataFrame) -> pd.DataFrame:
    loosen = zstandard.ZstdDecompressor()
    group = group.sort_values(["order"], kind="stable")
    texts = main_texts([json.loads(loosen.decompress(p)) for p in group["page"]])
    return pd.DataFrame(
        {
            "page_id": group["page_id"],
            "url": group["url"],
            "text": texts,
            "n_chars": [len(t) for t in texts],
            "n": group["n"],
        }
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages`.

    text has the blocks of the main text joined by an empty line, white space within a
    block being one space and character references decoded; it is empty if there is
    none. Null pages count as empty, and pages without a host are one host. Repeated
    rows stay repeated. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    source = pages.select(
        F.col("page_id").cast("long").cast("string").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host(F.col("url")).alias("host"),
        F.xxhash64("page_id", "url", "html").alias("order"),
        "html",
    )
    counts, _ = scratch.keep(
        pages.select(host(F.col("url")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("pages"))
    )
    few = counts.count() <= BROADCAST_HOSTS
    packed = source.mapInPandas(
        _pack, "page_id string, url string, host string, order long, n long, page binary"
    )
    dealt = packed.join(F.broadcast(counts) if few else counts, F.col("host") == F.col("of"))
    chunk = F.pmod(F.xxhash64("order"), F.ceil(F.col("pages") / F.lit(CHUNK)).cast("long"))
    return (
        dealt.withColumn("chunk", chunk)
        .drop("of", "pages")
        .groupBy("host", "chunk")
        .applyInPandas(_extract, "page_id string, url string, text string, n_chars long, n long")
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select(F.col("page_id").cast("long").alias("page_id"), "url", "text", "n_chars")
    )
