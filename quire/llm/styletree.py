"""Main text of web pages by site style trees."""

from __future__ import annotations

import html
import math
import re

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Spool, bounded_batches

#: Branches whose composite importance is below this are removed.
THRESHOLD = 0.3
#: Share of a page's text from which a branch is never removed as a whole.
MOST = 0.5
#: Weight of a branch's content against its presentation in its importance.
CONTENT_WEIGHT = 0.9
#: Importance of a branch that only one page has, towards which those of few pages lean.
UNKNOWN = 0.5
#: What a branch's importance is multiplied by for its names: none, one of NOISE_WORDS, one inside an article, reader comments.
NAME_WEIGHTS = (1.0, 0.5, 0.7, 0.25)

# HTML element sets (public standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol table tr tbody thead tfoot td th dl select article section div main body html aside nav header footer form blockquote".split())
# Elements that are never part of an article, and words of a class, id or role that speak against one.
NOISE_TAGS = frozenset("nav aside footer form button select option input dialog menu head".split()) | frozenset(RAW)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
NOISE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar share sharing social related recommended recommendations trending pagination pager skip search complementary contentinfo".split()
)
#: Words that may stand beside a word for reader comments without changing what it names.
BESIDE = frozenset("list box section area container wrapper block thread user reader item items body the".split())
#: Elements of running text: their names say how they look, not what they are.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figure figcaption table tbody tr".split())
TOKEN = re.compile(  # possessive, so that a broken tag costs one pass
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>"']|$))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)|\Z", re.I) for t in RAW}


class Node:
    """An element: its style (tag and class words), path in the style tree, children and own text in order."""

    __slots__ = ("tag", "style", "path", "parts", "noise", "level", "children", "up", "inside")

    def __init__(self, tag: str, style: str, noise: bool, level: int, up: Node | None):
        self.tag, self.style, self.noise, self.up = tag, style, noise, up
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        self.level = 2 if level == 1 and self.inside else level
        self.path = 0 if up is None else xxhash.xxh64_intdigest(f"{style} {self.level}".encode(), up.path) >> 1
        self.parts: list = []
        self.children: list[str] = []


def _branch(tag: str, attrs: str) -> tuple[str, bool, int]:
    """(style, whether it can't be part of an article by its element or as hidden, what its names speak for: see NAME_WEIGHTS)."""
    if not attrs.strip():
        return tag, tag in NOISE_TAGS, 0
    style, noise, level = [tag], tag in NOISE_TAGS, 0
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            names = [[w.lower() for w in WORD.findall(x)] for x in value.split()]
            words = [w for x in names for w in x]
            if tag not in PROSE and (tag not in ("body", "html", "main", "article") or name == "role"):
                if any(COMMENT_WORDS.intersection(x) and COMMENT_WORDS.union(BESIDE).issuperset(x) for x in names):
                    level = 3
                elif not NOISE_WORDS.isdisjoint(words):
                    level = max(level, 1)
            if name != "id":
                style += words
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            noise = True
    return ".".join(style), noise, level


def parse(text: str) -> Node:
    """The element tree of a page, with the end tags that HTML lets a page leave out. One pass over the text."""
    root = Node("", "", False, 0, None)
    node, at = root, 0
    open_: dict[str, int] = {}
    find = TOKEN.search

    def leave(to: Node) -> Node:
        up = node
        while up is not to:
            open_[up.tag] -= 1
            up = up.up
        return to

    while m := find(text, at):
        if m.start() > at:
            node.parts.append(text[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                node.parts.append(m["cdata"])
            continue
        tag, attrs = tag.lower(), m["attrs"]
        if m["end"]:
            up = node if open_.get(tag) else root
            while up is not root and up.tag != tag:
                if up.tag in SCOPE and tag in INLINE:
                    up = root
                    break
                up = up.up
            if up is not root:
                node = leave(up.up)
            elif tag in ("p", "br"):
                node.parts.append(" ")
            continue
        if tag in CLOSES_P or tag in SELF_CLOSING:
            ends = ("p",) if tag in CLOSES_P else SELF_CLOSING[tag]
            up = node if any(open_.get(t) for t in ends) else root
            top = None
            while up is not root and (up.tag in ends or up.tag not in SCOPE):
                if up.tag in ends:
                    top = up
                up = up.up
            while up is not root and up.tag in ends:  # table parts are scopes themselves
                top, up = up, up.up
            if top is not None:
                node = leave(top.up)
        style, noise, level = _branch(tag, attrs)
        node.children.append(style)
        if tag in VOID:
            if tag not in INLINE:
                node.parts.append(" ")
            continue
        made = Node(tag, style, noise, level, node)
        node.parts.append(made)
        if tag in RAW_END:
            at = RAW_END[tag].search(text, at).end()
        elif not attrs.endswith("/"):
            node = made
            open_[tag] = open_.get(tag, 0) + 1
    if at < len(text):
        node.parts.append(text[at:])
    return root


def _elements(root: Node) -> list[Node]:
    """All elements in page order, parents before their children."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.parts) if not isinstance(c, str)]
    return out


def style_rows(root: Node) -> list[tuple[int, int, int, int, int, int]]:
    """(path, what its names speak for, presentation hash, content hash, characters, characters in links) of each style path of a page.

    Elements of one path are one branch: its presentation is the sequence of its children's styles, its content
    the text below it. Elements inside a line are branches of their own only if their names speak against them.
    """
    order = _elements(root)
    below: dict[int, tuple[int, int, int]] = {}  # (content hash, characters, characters in links) of each element
    digest = lambda xs: xxhash.xxh64_intdigest("\x01".join(xs).encode("utf-8", "replace")) >> 1
    for x in reversed(order):
        texts, chars, linked = [], 0, 0
        for c in x.parts:
            if isinstance(c, str):
                t = " ".join(c.split())
                texts += [t] if t else []
                chars += len(t)
            elif c.tag not in RAW_END:
                h, n, k = below[id(c)]
                texts += [f"\x02{h}"] if n else []
                chars, linked = chars + n, linked + k
        below[id(x)] = (digest(texts), chars, chars if x.tag == "a" else linked)
    rows: dict[int, list] = {}
    out_of = {id(root): False}
    for x in order[1:]:
        out_of[id(x)] = out_of[id(x.up)] or x.noise
        if out_of[id(x)] or (x.tag in INLINE and not x.level) or not below[id(x)][1]:
            continue
        e = rows.setdefault(x.path, [x.level, [], [], 0, 0])
        h, n, k = below[id(x)]
        e[1].append("/".join(x.children))
        e[2].append(str(h))
        e[3] += n
        e[4] += k
    return [(p, e[0], digest(e[1]), digest(e[2]), e[3], e[4]) for p, e in rows.items()]


def lone_low(root: Node) -> frozenset:
    """The low branches of a page that is the only one of its host."""
    return frozenset(p for p, level, _, _, n, k in style_rows(root) if UNKNOWN * (1 - k / n) * NAME_WEIGHTS[level] < THRESHOLD)


def _drop(root: Node, low: frozenset) -> None:
    """Marks the low branches of a page as noise, but none that holds its article or most of its text.

    Where a page marks articles outside of low branches, those inside (comments, say) don't count. Inside an article
    nothing goes if most of it would.
    """
    order = _elements(root)
    if not any(x.path in low for x in order):
        return
    size: dict[int, int] = {}
    holds: set[int] = set()
    shut: set[int] = set()
    free = False  # an article that no low branch holds
    for x in order:
        if x.noise or x.path in low or (x.up is not None and id(x.up) in shut):
            shut.add(id(x))
        elif x.tag in ("article", "main"):
            free = True
    lost: dict[int, int] = {}
    for x in reversed(order):
        inside = [c for c in x.parts if not isinstance(c, str)]
        size[id(x)] = 0 if x.noise else sum(len("".join(c.split())) for c in x.parts if isinstance(c, str)) + sum(size[id(c)] for c in inside)
        lost[id(x)] = size[id(x)] if x.path in low else sum(lost[id(c)] for c in inside)
        if not x.noise and (x.tag in ("article", "main") or any(id(c) in holds for c in inside)):
            holds.add(id(x))
    spared: set[int] = set()  # articles that would lose most of their text
    for x in order:
        if x.up is not None and id(x.up) in spared or (x.tag in ("article", "main") and lost[id(x)] >= MOST * max(1, size[id(x)])):
            spared.add(id(x))
        if x.path in low:
            most = id(x) in holds if id(root) in holds else size[id(x)] >= MOST * size[id(root)]
            names = x.level == 3 and id(x) not in holds
            x.noise |= not (most and not free) and (names or id(x) not in spared)


def _mains(order: list[Node]) -> list[Node]:
    """The outermost articles, and the outermost main elements without one, that no noise branch holds."""
    state: dict[int, int] = {}  # 0 outside, 1 in a main, 2 in an article, 3 in noise
    found, holders = [], {}
    for x in order:
        s = state[id(x.up)] if x.up is not None else 0
        top = holders.get(id(x.up))
        if x.noise:
            s = 3
        elif s < 2 and x.tag == "article":
            found.append((x, top))
            s = 2
        elif s == 0 and x.tag == "main":
            found.append((x, None))
            s, top = 1, x
        state[id(x)] = s
        if top is not None:
            holders[id(x)] = top
    full = {id(top) for x, top in found if top is not None}
    return [x for x, _ in found if id(x) not in full]


def _flat(node: Node, out: list[str]) -> None:
    """Text below a node in page order, without noise; a space at each block's edge."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not x.noise:
            edge = [] if x.tag in INLINE else [" "]
            stack += [*edge, *reversed(x.parts), *edge]


def main_text(page: str | None, low: frozenset | None = None) -> str:
    """The main text of a page; low: paths of its host's style tree that are of low importance (default: judged by this page alone)."""
    if not page:
        return ""
    root = parse(page)
    _drop(root, lone_low(root) if low is None else low)
    order = _elements(root)
    out: list[str] = []
    mains = _mains(order)
    if not mains:
        for x in order:
            x.noise |= x.tag == "header"
    for n in mains or [root]:
        _flat(n, out)
        out.append(" ")
    if not mains and not "".join(out).split():  # nothing but headers
        for x in order:
            x.noise &= x.tag != "header"
        _flat(root, out)
    return " ".join(html.unescape("".join(out)).split())


def _tree(batches):
    import pyarrow as pa

    for b in batches:
        rows = []
        for host, sign, page in zip(*(b.column(i).to_pylist() for i in range(3))):
            rows += [(host, sign, *r) for r in style_rows(parse(page))]
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "page", "path", "level", "look", "content", "chars", "linked"])


def low_branches(pages: DataFrame, url_col: str, html_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(host, paths): branches of low composite importance in each host's style tree.

    Over the m different pages of a host that have a branch, its content and its presentation are distributions; their
    entropies against log m are 1 if every page differs and 0 if all agree, and lean towards UNKNOWN if m is small.
    Importance is the content's, with a part of the presentation's, times the share of the text outside links and the
    weight of what the branch's names speak for.
    """
    made = pages.select(host_of(url_col).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html")).filter("html is not null")
    rows = made.mapInArrow(_tree, "host string, page long, path long, level int, look long, content long, chars long, linked long").distinct()

    def entropy(what: str) -> DataFrame:
        n = rows.groupBy("host", "path", "level", what).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
        return n.groupBy("host", "path", "level").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).select(
            "host", "path", "level", "m", "chars", "linked", (F.log("m") - F.col("nlogn") / F.col("m")).alias(f"h_{what}")
        )

    both = entropy("content").join(entropy("look").select("host", "path", "h_look"), ["host", "path"])
    lean = math.log(2)
    mixed = (CONTENT_WEIGHT * F.col("h_content") + (1 - CONTENT_WEIGHT) * F.col("h_look") + UNKNOWN * lean) / (F.log("m") + lean)
    importance = mixed * (1 - F.col("linked") / F.col("chars")) * F.element_at(F.array(*map(F.lit, NAME_WEIGHTS)), F.col("level") + 1)
    return both.filter(importance < threshold).groupBy("host").agg(F.collect_set("path").alias("paths"))


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\w+://(?:[^/@]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text: the main text of the page.

    A host's style tree (merged element trees of its different pages, as counts by path) gives every branch its
    importance; each page loses its branches of low importance, inside a marked article (article, main) too, and the
    elements that are never part of one. Where a page marks its article, what lies outside is left out. No branch goes
    that holds the article or most of the page's text. Null and empty pages have the empty text, a null url is of the
    host without a name, repeated rows stay. Empty table: no rows. Counts are made per (host, path, hash) with partial
    sums, so a host with most of the pages is no hot group; the table that goes back to the pages holds the low paths of
    a host's templates, one row a host.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    low = Spool(spark, "styles").put(low_branches(pages, url_col, html_col))

    def of(batches):
        import pyarrow as pa

        none, host, paths = frozenset(), None, frozenset()
        for b in batches:
            out = []
            for name, page, low_paths in zip(b.column("host"), b.column("html"), b.column("paths")):
                if (name := name.as_py()) != host:  # the pages of a host share one set
                    host, paths = name, frozenset(low_paths.as_py() or none)
                out.append(main_text(page.as_py(), paths))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host")).join(low, "host", "left")
    kind = rows.schema
    return rows.select("id", "url", "html", "host", "paths").mapInArrow(of, f"id {kind['id'].dataType.simpleString()}, url string, text string")


def op1_styletree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
