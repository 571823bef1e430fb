"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree whose nodes are the paths of element styles (tag and class names) from the body down; the text directly in a path is a leaf below it. Importance runs
from 0, the same on every page, to 1, different on every page, and is composed from the leaves up:

- A leaf's features on a page are its pairs of neighbouring words; that of a feature found on c of the leaf's m pages has entropy log c / log m. A leaf's importance is one minus the mean entropy
  of its features, all pairs of its blocks. Inside a declared article, where only what never changes may go, a whole block is one feature, and only whole elements go.
- A node's presentation has the entropy of the styles of its children over its m pages; with l different ones it counts 1 - g**l, and the mean importance of its children g**l, each
  page's children counting alike (g = `GAMMA`).

A branch of low importance in which no text is of importance is removed from each page. Branches that are noise by their tag or role, or hidden, always go. Class names and ids that speak of noise are a prior only: on a site of
enough pages they raise the importance that a branch needs, on smaller ones they decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, written

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
OPEN = re.compile(r"<(?=[A-Za-z/!?])")
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+")
#: Numbers of articles, users and the like in class names; shorter ones belong to the name (col-2).
NUMBER = re.compile(r"[0-9]{3,}")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp svg object annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What ends a drawing that is never closed.
AFTER_DRAWING = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)
#: A start tag of the set ends an open element of that name.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
NOISE_TAGS = frozenset("aside button dialog footer menu nav select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names that speak for a branch being no part of the article; words that make a class name speak of what is below or missing (has-sidebar).
NOISE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
RELATIONS = frozenset("has have no not with without".split())
#: Words that add nothing to a noise word in a class name.
COMPANIONS = frozenset("area bar block body bottom box button buttons col column container content group header icon icons inner item items left link links list outer right row section text title top wrap wrapper".split())
#: How far a name speaks for noise: all its words, or all but companions, or one of them.
PURE, JOINED, PARTLY = 1, 2, 3
#: Share of words in links from which a branch that is named so is noise, and words up to which it is noise outside the article.
LINKS, SHORT = 0.5, 8
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Importance under which a branch is noise outside and inside the declared article, from that many pages on; weight of what is below a node against its presentation.
OUTSIDE, INSIDE, LEAST_PAGES, LEAST_INSIDE, GAMMA = 0.3, 0.05, 4, 10, 0.9
#: Importance of a text that keeps the branches around it.
HOLDS = 0.5
#: Importance, its own and that of its texts, under which a branch with a noise name is noise, on a host of LEAST_PAGES or more.
NAMED = 0.6
#: Most noise keys that are sent to every executor (8 bytes each); beyond it the keys of each page's own paths are joined with them.
MOST_SENT = 262_144


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "replace")) - (1 << 63)


#: The path that stands for a page as a whole: its key is sent for hosts that have a tree.
ROOT = _key("")


class Node:
    __slots__ = ("tag", "path", "up", "noise", "named", "below", "inside", "declared", "wraps", "first", "last", "begin", "end", "linked", "styles")

    def __init__(self, tag: str, path: int, up: Node | None = None, noise: bool = False, named: int = 0, below: bool = False, inside: bool = False, declared: bool = False):
        self.tag, self.path, self.up, self.noise, self.named, self.below, self.inside, self.declared = tag, path, up, noise, named, below, inside, declared
        self.wraps = False
        self.linked = tag == "a" or up is not None and up.linked
        self.first = self.last = 0  # its blocks
        self.begin = self.end = 0  # and its runs of text
        self.styles: list[str] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}


def _noise_names(a: dict[str, str], header: bool) -> tuple[int, str]:
    """How far the class names speak for noise (0: not), and the id if all its words do."""
    known = NOISE_NAMES | {"header"} if header else NOISE_NAMES
    words = [w for c in a.get("class", "").lower().split() if (w := set(NAME.findall(c))) & known and not w & RELATIONS]
    own = NAME.findall(a.get("id", "").lower())
    level = min((PURE if w <= known else JOINED if w <= known | COMPANIONS else PARTLY for w in words), default=0)
    return level, "-".join(own) if own and known.issuperset(own) else ""


def _open(tag: str, raw: str, up: Node) -> Node:
    a = _attributes(raw)
    role = a.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower()
    by_class, by_id = (0, "") if main or tag in HEADINGS or tag in ("body", "html") else _noise_names(a, not up.declared)
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "").lower())
    noise = up.noise or tag in NOISE_TAGS or bool(hidden) or tag == "header" and not up.declared or role in NOISE_ROLES
    style = ".".join([tag, *sorted(set(NUMBER.sub("0", a.get("class", "").lower()).split()))]) + (f"#{by_id}" if by_id else "")
    up.styles.append(style)
    named = PURE if by_id else by_class
    below = up.below or named > 0
    if main and not noise:
        node = up
        while node and not node.wraps:
            node.wraps, node = True, node.up
    return Node(tag, _key(str(up.path), style), up, noise, named, below, (up.inside or main and not below) and not noise, (up.declared or main) and not noise)


Piece = tuple[str, Node]


def parse(page: str) -> tuple[list[tuple[list[Piece], Node]], list[Node], list[Piece]]:
    """The blocks of a page in order, each as its runs of text with the element that holds each, and the block's own element (the innermost open one that makes blocks); all elements below the root, at any depth, and all runs of text. Time is in proportion to the page.

    SVG and the annotations of formulas, which are not shown, have no text. Formulas have. Of a title, frame or the like that is never closed only the text up to the next tag is lost, of a drawing that up to the next tag that makes a block.
    Comments end as in HTML (also at <!-->, <!---> and --!>); one that never ends takes the rest of the page.
    An article below a noise name counts if the page has no other one; the elements around it are then no noise by name. A form is noise unless it is around an article.
    """
    root = Node("", ROOT)
    stack, nodes, blocks, run, runs = [root], [], [], [], []
    tops: list[int] = []  # places of open block elements
    places: dict[str, list[int]] = {}  # and of all by tag
    at, n = 0, len(page)

    def flush():
        nonlocal run
        if run:
            if not all(text.isspace() for text, _ in run):
                blocks.append((run, stack[tops[-1]] if tops else root))
            run = []

    def close_from(k: int):
        while len(stack) > k:
            node = stack.pop()
            node.last, node.end = len(blocks), len(runs)
            places[node.tag].pop()
            if node.tag in BLOCK:
                tops.pop()

    while at < n:
        m = OPEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            run.append((page[at:end], stack[-1]))
            runs.append(run[-1])
        if not m:
            break
        at = end
        if page.startswith("<!--", at):
            at = COMMENT.match(page, at).end()
            continue
        if page[at + 1] in "!?":
            close = page.find(">", at)
            at = n if close < 0 else close + 1
            continue
        t = TAG.match(page, at)
        if not t:  # such as </>
            close = page.find(">", at)
            at = n if close < 0 else close + 1
            continue
        at = t.end()
        slash, tag, raw = (t[1], t[2], t[3]) if t[2] else (t[4], t[5], t[6])
        tag = tag.lower()
        if not slash and raw.endswith("/") and (tag in ("svg", "math") or places.get("math")):
            continue
        if not slash and tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if not close and tag == "svg":
                drawn = AFTER_DRAWING.search(page, at)
                at = drawn.start() if drawn else n
                continue
            if not close and tag not in ("script", "style"):  # never closed: its own text goes, no element after it
                at = (page.find("<", at) + 1 or n + 1) - 1
                continue
            stop = page.find(">", close.start()) if close else -1
            at = n if stop < 0 else stop + 1
            continue
        if tag == "br":
            run.append((" ", stack[-1]))
            runs.append(run[-1])
            continue
        if tag in BLOCK:
            flush()
        if slash:
            k = places[tag][-1] if places.get(tag) else 0
            if k and (tag in BLOCK or not tops or k > tops[-1]):
                close_from(k)
            continue
        if tag in VOID:
            continue
        if tops and tag in CLOSES.get(stack[tops[-1]].tag, ()):
            flush()
            close_from(tops[-1])
        if tag not in ("html", "head"):
            node = _open(tag, raw, stack[-1])
            node.first, node.begin = len(blocks), len(runs)
            if tag in BLOCK:
                tops.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            nodes.append(node)
            stack.append(node)
    flush()
    close_from(1)
    for node in nodes:  # parents come first
        node.noise = node.noise or node.up.noise or node.tag == "form" and not node.wraps
        node.inside, node.declared = node.inside and not node.noise, node.declared and not node.noise
    if not any(node.inside for node in nodes):
        for node in nodes:
            node.inside, node.named = node.declared, 0 if node.wraps else node.named
    return blocks, nodes, runs


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def shown(pieces: list[Piece], block: Node) -> str:
    """The text of a block without what is noise within it; all of a block that is noise itself."""
    return clean("".join(text for text, node in pieces if block.noise or not node.noise))


def by_name(nodes: list[Node], runs: list[Piece]) -> set[Node]:
    """The elements that are noise by their name: those of a pure name; outside the article those with companions too; others if they are mostly links or, outside the article, short."""
    named = [node for node in nodes if node.named and not node.noise]
    if not named:
        return set()
    many = [len(text.split()) for text, _ in runs]
    words = [0, *accumulate(many)]
    linked = [0, *accumulate(m * node.linked for m, (_, node) in zip(many, runs, strict=True))]
    out = set()
    for node in named:
        size, links = words[node.end] - words[node.begin], linked[node.end] - linked[node.begin]
        if node.named == PURE or node.named == JOINED and not node.inside or links >= LINKS * max(1, size) or not node.inside and size <= SHORT:
            out.add(node)
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").netloc or "").lower()
    except ValueError:
        return ""


def leaf_of(path: int) -> int:
    """The path of the text directly in an element."""
    return _key(str(path), "#text")


def features(block: str, inside: bool) -> list[int]:
    """Hashes of a block's pairs of neighbouring words (of a single word); inside the declared article one of the whole block."""
    words = block.split()
    if inside or len(words) < 2:
        return [_key(" ".join(words))]
    return sorted({_key(a, b) for a, b in zip(words[:-1], words[1:], strict=True)})


def page_nodes(page: str) -> list[tuple[int, int | None, int, float, int, list[int], bool, bool, bool]]:
    """(path, parent, depth, share, style, features, inside the article, the article itself, a noise name) of each path with text on the page, of the texts in them (leaves, the only ones with
    features), and of the page. share: one by the number of the parent's children on the page. What one path has in several places counts together."""
    blocks, nodes, _ = parse(page)
    up: dict[int, int | None] = {ROOT: None}
    depth, style, found = {ROOT: 0}, {ROOT: []}, {}
    flags: dict[int, tuple[bool, bool, bool]] = {ROOT: (False, False, False)}
    for node in nodes:
        if node.last > node.first and node.path not in up:
            up[node.path], depth[node.path] = node.up.path, depth[node.up.path] + 1
            flags[node.path] = (node.inside, node.inside and node.tag in ("article", "main"), node.named > 0)
        style.setdefault(node.path, []).extend(dict.fromkeys(node.styles))
    for pieces, node in blocks:
        leaf = leaf_of(node.path)
        up[leaf], depth[leaf], flags[leaf] = node.path, depth[node.path] + 1, (node.inside, False, False)
        found.setdefault(leaf, set()).update(features(shown(pieces, node), node.inside))
    many: dict[int | None, int] = {}
    for parent in up.values():
        many[parent] = many.get(parent, 0) + 1
    return [(p, parent, depth[p], 1 / many[parent], _key(*dict.fromkeys(style.get(p, ()))), sorted(found.get(p, ())), *flags[p]) for p, parent in up.items()]


def main_text(page: str, host: str, noise: frozenset[int]) -> str:
    """The page's article: blocks inside article or main elements if it has any, else all, without branches and parts of blocks that are noise by tag, role or hiding, in the host's tree, or by name.

    Names decide on hosts without a tree, and everywhere on elements within a block, which are in no tree. A page of which the tree would leave nothing is read as if its host had none; one of which names would leave nothing, without names.
    """
    blocks, nodes, runs = parse(page)
    any_inside = any(block.inside and not block.noise and shown(pieces, block) for pieces, block in blocks)
    blocks = [(pieces, block) for pieces, block in blocks if not block.noise and (block.inside or not any_inside)]
    has_tree, bad = _key(host, str(ROOT)) in noise, by_name(nodes, runs)
    for tree, names in ((True, True), (False, True), (False, False)) if has_tree else ((False, True), (False, False)):
        low: dict[Node, bool] = {}
        for node in nodes:  # those around an element come before it
            of_tree = tree and node.last > node.first
            low[node] = low.get(node.up, False) or (_key(host, str(node.path)) in noise if of_tree else names and node in bad)
        kept = []
        for pieces, block in blocks:
            if not low.get(block, False) and not (tree and _key(host, str(leaf_of(block.path))) in noise):
                kept.append(clean("".join(text for text, node in pieces if not node.noise and not low.get(node, False))))
        if any(kept):
            return "\n".join(text for text in kept if text)
    return ""


def page_keys(page: str, host: str) -> set[int]:
    """The keys of which main_text may ask for a page."""
    return {_key(host, str(x[0])) for x in page_nodes(page)}


def tree_nodes(pages: DataFrame) -> DataFrame:
    """The merged trees of all hosts: key (of host and path), root (the key of the host's root), up (the parent's key), depth, m (pages), inside, article, named, importance, and top (the largest importance of a text in it); counts are combined before each shuffle."""
    names = ("root", "key", "up", "depth", "share", "style", "features", "inside", "article", "named")
    ddl = "root long, key long, up long, depth int, share double, style long, features array<long>, inside boolean, article boolean, named boolean"
    types = (*[pa.int64()] * 3, pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int64()), *[pa.bool_()] * 3)
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        for batch in slices(batches, "html"):
            rows = []
            for u, p in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if p and (h := host_of(u)):
                    root = _key(h, str(ROOT))
                    rows += [(root, _key(h, str(path)), None if up is None else _key(h, str(up)), *x) for path, up, *x in page_nodes(p)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    seen = pages.mapInArrow(run, ddl)
    own = F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("value")))
    each = seen.withColumn("x", F.explode(F.concat(own, F.transform("features", lambda f: F.struct(F.lit(1).alias("kind"), f.alias("value"))))))
    flags = [F.max(c).alias(c) for c in ("inside", "article", "named")]
    counts = each.groupBy("root", "key", "up", "depth", "x.kind", "x.value").agg(F.count("*").alias("c"), F.sum(F.when(F.col("x.kind") == 0, F.col("share"))).alias("share"), *flags)
    of = lambda k, x: F.coalesce(F.sum(F.when(F.col("kind") == k, x)), F.lit(0.0))
    c = F.col("c").cast("double")
    nodes = counts.groupBy("root", "key", "up", "depth").agg(of(0, c).alias("m"), of(0, F.lit(1.0)).alias("l"), of(0, c * F.log(c)).alias("styles"), of(1, c).alias("n"), of(1, c * F.log(c)).alias("found"), F.sum("share").alias("share"), *flags)
    varied = lambda sums, n: F.when(F.col("m") > 1, F.lit(1.0) - F.col(sums) / F.col(n) / F.log("m")).otherwise(1.0)
    passed = F.pow(F.lit(GAMMA), F.col("l"))
    nodes = written(nodes.withColumn("own", F.when(F.col("n") > 0, varied("found", "n")).otherwise((1 - passed) * varied("styles", "m"))), "nodes")
    parents = nodes.select(F.col("key").alias("up"), (passed / F.col("m")).alias("passed"))
    now = nodes.join(parents, "up", "left").select("key", "up", (F.col("share") * F.col("passed")).alias("w"), F.col("own").alias("s"), F.when(F.col("n") > 0, F.col("own")).otherwise(0.0).alias("top"))
    # What a node passes up reaches its ancestors in rounds of doubled steps: s is a node's own and what came from below, w the weight with which it arrives `up` there.
    for _ in range((nodes.agg(F.max("depth")).first()[0] or 0).bit_length()):
        now = written(now, "steps")
        come = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum(F.col("w") * F.col("s")).alias("come"), F.max("top").alias("high"))
        hop = now.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("w").alias("more"))
        now = now.join(come, "key", "left").join(hop, "up", "left").select("key", F.col("next").alias("up"), (F.col("w") * F.col("more")).alias("w"), (F.col("s") + F.coalesce("come", F.lit(0.0))).alias("s"), F.greatest("top", "high").alias("top"))
    return written(nodes.join(now.select("key", F.col("s").alias("importance"), "top"), "key"), "tree")


def noise_keys(pages: DataFrame) -> DataFrame:
    """The keys of all branches of low importance, and of the root of each host of LEAST_PAGES."""
    nodes = tree_nodes(pages)
    varied = nodes.filter("article AND importance >= 0.5").select("root").distinct().withColumn("varied", F.lit(True))
    large = nodes.filter((F.col("key") == F.col("root")) & (F.col("m") >= LEAST_PAGES)).select("root")
    nodes = nodes.filter("up IS NOT NULL").withColumn("keeps", F.col("top") >= HOLDS)
    outside = ~F.col("keeps") & ~F.col("inside") & (F.col("m") >= LEAST_PAGES) & (F.col("importance") < OUTSIDE)
    inside = ~F.col("keeps") & (F.col("n") == 0) & F.col("inside") & ~F.col("article") & (F.col("m") >= LEAST_INSIDE) & (F.col("importance") < INSIDE)
    found = nodes.filter(outside | inside).join(varied, "root", "left").filter("NOT inside OR varied").join(large, "root", "left_semi").select("key")
    named = nodes.filter(F.col("named") & (F.col("importance") < NAMED) & (F.col("top") < NAMED)).join(large, "root", "left_semi").select("key")
    return found.union(named).union(large.select(F.col("root").alias("key"))).distinct()


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) to page_id, url, text, n_chars, one row for each row given.

    Blocks are joined in page order by a newline, white space inside a block is one space, character references are decoded. A null or empty page, or one without an article, has an
    empty text. Pages without a host have no tree. Copies of a page count as pages of their host. Other columns are not read. An empty table gives no rows.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keys = written(noise_keys(own), "noise")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    ddl = "page_id long, url string, text string, n_chars long"

    def texts(batch: pa.RecordBatch, noise: Iterator[frozenset[int]]) -> pa.RecordBatch:
        out = [main_text(p, host_of(u), n) if p else "" for u, p, n in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), noise, strict=False)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=schema)

    sent = keys.limit(MOST_SENT + 1).collect()
    if len(sent) <= MOST_SENT:
        packed = np.array([r["key"] for r in sent], np.int64)

        def run(batches):
            noise = frozenset(packed.tolist())
            for batch in slices(batches, "html"):
                yield texts(batch, iter([noise] * batch.num_rows))

        return own.mapInArrow(run, ddl)

    def asked(batches):
        for batch in slices(batches, "html"):
            digests, urls, pages_ = (batch.column(c).to_pylist() for c in ("digest", "url", "html"))
            for d, u, p in zip(digests, urls, pages_, strict=True):
                if p and (h := host_of(u)):
                    of_page = sorted(page_keys(p, h))
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(of_page), pa.string()), pa.array(of_page, pa.int64())], names=["digest", "key"])

    def run_joined(batches):
        for batch in slices(batches, "html"):
            yield texts(batch, (frozenset(x or ()) for x in batch.column("keys").to_pylist()))

    marked = own.withColumn("digest", F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("\0"), "html"), 256))  # equal pages have equal keys; null for a null page
    low = marked.select("digest", "url", "html").mapInArrow(asked, "digest string, key long").join(keys, "key", "left_semi")
    by_page = low.groupBy("digest").agg(F.collect_set("key").alias("keys"))  # at most the page's own paths
    return marked.join(by_page, "digest", "left").select("page_id", "url", "html", "keys").mapInArrow(run_joined, ddl)
