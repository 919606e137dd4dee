"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles. A node stands for all elements that are reached by the same path of tags
and class names; on a page it has a presentation, the sequence of its children, and a content, the texts directly in it. Over
the pages that have the node, its presentation entropy tells how much the presentation varies; the content importance of its texts
is one less their entropy over the pages: 0 for texts that are on all of them, 1 for texts of a single page. The composite importance of
a node joins its own presentation with the content of the whole branch beneath it. A branch is noise if neither it nor any text in it
is important: texts of such nodes are removed from each page, and so are elements too rare to be judged that stand in a noisy branch.

Markup is the prior. Elements whose tag or name can only be navigation, advert, form, comments and the like never get into the tree.
A name that hints at such a part but may name a subject as well (market-share, job-search, footer-notes) goes into the tree with a
higher bar: its texts stay only in an article or main element, where the tree has found them to be each page's own. Inside an
article or main element a node has to vary less to be removed, and where the tree cannot judge a node, such an element decides if it
holds half of the page's text or more.
"""

import re
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, small, table

#: A node is judged from this many pages of a host on; below these importances a text outside and inside an article goes.
MIN_PAGES, OUTSIDE, INSIDE = 5, 0.3, 0.1
#: Below this importance a text goes that stands in a part whose name hints at no article.
HINTED = 0.9
#: What a style takes from the weight of the content beneath a node, for each style that the node has.
STYLE_DECAY = 0.9
#: Elements deeper than this share the node of the one at this depth.
DEPTH = 48
#: Verdicts up to this many are sent to every executor; more are joined by a shuffle.
BROADCAST_NODES = 200_000

# Names of the HTML standard and common names of page parts.
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video nav footer aside form button select textarea input dialog menu head title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
#: Names that make a part of the page wherever they stand in a class or id; those that do as its last word, as in cookie-banner; and
#: those of the latter that are no part's alone once another word than a part's or a layout's qualifies them, as in market-share.
PARTS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs disqus footer gdpr masthead nav navbar navigation newsletter pagination popup sidebar sponsored".split())
LAST = frozenset("banner comment comments consent cookie cookies login menu modal notice notices overlay pager promo related replies search share sharing signup skip social sponsor subscribe toolbar widget widgets".split())
HINTS = frozenset("banner login menu modal notice notices overlay pager related replies search share sharing social toolbar widget widgets".split())
#: Words before a part's name that leave it one, and those that say that a page lacks or lies beside it: no-sidebar, content-with-sidebar.
OF_PAGE = frozenset("blog article cms global js legal my page privacy reader readers site sticky fixed floating user visitor web wp".split())
BESIDE = frozenset("has hide hides no non not with without".split())
#: Words that say how a part is laid out; the word before them names it.
LAYOUT = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content entry feed first form global group header holder icon icons inner item items last layer layout left link links list main media mobile outer panel posts primary right row secondary section site slot stories strip tab text thread title to top unit view wrap wrapper".split()
)

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|</(?![a-zA-Z])[^>]*>|</?([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
#: The same where quotes hide no end of a tag.
_PLAIN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|</(?![a-zA-Z])[^>]*>|</?([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_WORDS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What the start of one element ends in another that is still open.
_ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
_ENDED_BY = {tag: [t for t, of in _ENDS.items() if tag in of] for tag in BLOCKS | DROPPED}
#: Ends of other blocks do not reach beyond these.
_LIMITS = ("article", "main", "body")
_SCOPE = frozenset("article main section div ul ol dl table td th blockquote body nav aside form footer header".split())


def part_by_name(name: str) -> int:
    """2: a class or id names a part of the page that is no article (ad-slot, site-footer, cookie-notice); 1: it may (market-share, footer-notes); 0: it does not."""
    words = [w.lower() for w in _WORDS.findall(_CAMEL.sub("-", name.split("--")[0]))]
    words = [w for w in words if len(w) > 1]
    beside = next((i for i, w in enumerate(words) if w in BESIDE), len(words))
    words = words[:beside]
    while words and words[-1] in LAYOUT:
        words.pop()
    if not words:
        return 0
    firm = PARTS | LAST | LAYOUT - {"text"} | OF_PAGE
    if words[-1] in PARTS or any(w in PARTS for w in words) and all(w in firm for w in words):
        return 2
    if words[-1] in LAST:
        return 1 if words[-1] in HINTS and not all(w in firm for w in words) else 2
    return 1 if any(w in PARTS for w in words) else 0


def _attributes(attrs: str) -> tuple[str, int, frozenset]:
    """Of a start tag: its class names and id without digits, as one text; how far they, its role or a hidden attribute name a part (0 to 2); the classes."""
    if not attrs.strip(" \t\n\r\f/"):
        return "", 0, frozenset()
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = [*a.get("class", "").split(), *a.get("id", "").split()]
    firm = a.get("role", "").lower() in ROLES or a.get("aria-hidden", "").lower() == "true" or "hidden" in a
    part = 2 if firm else max(map(part_by_name, names), default=0)
    return " ".join(re.sub(r"\d+", "", n.lower()) for n in names), part, frozenset(n.lower() for n in a.get("class", "").split())


class Page:
    """The text blocks of a page in order, and the nodes of the style tree that it has.

    blocks: (node, whether inside an article or main element, text); tree: node to (its ancestors from the top, whether inside, whether
    a name hints at a part, the presentation on this page). Nodes are 64-bit hashes of the host and the path. Parts named as such are in
    neither, but for an article in one where the page has no other. Character references are decoded and white space is one blank.
    Markup of any kind gives some result in a time linear in its length, and no text is lost to broken quotes.
    """

    def __init__(self, host: str, html: str | None):
        self.blocks: list[tuple[int, bool, str]] = []
        self.tree: dict[int, tuple[tuple, bool, bool, int]] = {}
        if html and self._parse(host, html, names=True) and not any(inside for _, inside, _ in self.blocks):
            self.blocks, self.tree = [], {}
            self._parse(host, html, names=False)

    def _parse(self, host: str, html: str, names: bool) -> bool:
        """Fills blocks and tree; with names, tells whether a part named as such holds an article, and else takes that article."""
        from xxhash import xxh64_intdigest

        digest = lambda *x: xxh64_intdigest("\x00".join(map(str, x)))
        # An open element: tag, node, ancestors, dropped (1: by a name, 2: by its tag), inside, hash of its children so far, whether hinted, innermost scope.
        stack: list[list] = [["", digest(host), (), 0, False, 0, False, 0]]
        # Where the open elements of a tag stand.
        opened: dict[str, list[int]] = {}
        text: list[str] = []
        hidden = False

        def flush() -> None:
            if text:
                if line := " ".join(unescape("".join(text)).split()):
                    at = stack[-1]
                    self.blocks.append((at[1], at[4], line))
                    at[5] = digest(at[5], "text")
                text.clear()

        def leave() -> None:
            _, node, above, dropped, inside, style, hinted, _ = stack.pop()
            if not dropped:
                seen = self.tree.get(node)
                self.tree[node] = (above, inside, hinted, style if seen is None else digest(seen[3], style))

        def close(to: int) -> None:
            flush()
            while len(stack) > to:
                opened[stack[-1][0]].pop()
                leave()

        last_of = lambda tags: max((opened[t][-1] for t in tags if opened.get(t)), default=0)
        at, end, last, token = 0, len(html), html.rfind(">") + 1, _TOKEN
        while at < end:
            # Behind the last > only an open comment is markup.
            start = html.find("<", at)
            if start >= last or start < 0:
                start = html.find("<!--", at)
            m = token.match(html, start) if start >= 0 else None
            if m is None and 0 <= start < last and token is _TOKEN and html[start + 1 : start + 2].isascii() and html[start + 1 : start + 3].strip("/")[:1].isalpha():
                # A tag whose quotes run to the end of the page: from here on they hide nothing.
                token = _PLAIN
                m = token.match(html, start)
            stop = start if m else end if start < 0 else start + 1
            if stop > at and not stack[-1][3]:
                text.append(html[at:stop])
            at = m.end() if m else stop
            if m is None or not m[1]:
                continue
            tag = m[1].lower()
            if html[m.start() + 1] == "/":
                if not opened.get(tag):
                    if tag in BLOCKS:
                        flush()
                elif tag in BLOCKS or tag in DROPPED:
                    i = opened[tag][-1]
                    if tag not in BLOCKS or tag in _LIMITS or tag == "html" or i > last_of(_LIMITS):
                        close(i)
                continue
            if tag == "br":
                if not stack[-1][3]:
                    text.append(" ")
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at, max(at, last))
                at = stop.end() if stop else end
                continue
            if tag not in BLOCKS and tag not in DROPPED:
                continue
            flush()
            i = last_of(_ENDED_BY.get(tag, ()))
            if i and i >= stack[-1][7]:
                close(i)
            if tag in VOID:
                continue
            name, part, classes = _attributes(m[2])
            up = stack[-1]
            if tag in ("html", "body", "main") or tag == "article" and "comment" not in name:
                part = 0
            above = up[3]
            if above == 1 and part == 0 and tag in ("article", "main"):
                hidden = True
                above = above if names else 0
            inside = up[4] or tag in ("article", "main")
            drop = max(above, 2 if tag in DROPPED or (not inside and (tag == "header" or "header" in classes)) else part == 2)
            if not drop:
                up[5] = digest(up[5], tag, name)
            deep = len(up[2]) >= DEPTH
            scope = len(stack) if tag in _SCOPE else up[7]
            opened.setdefault(tag, []).append(len(stack))
            stack.append([tag, up[1] if deep else digest(up[1], tag, name), up[2] if deep else (*up[2], up[1]), int(drop), inside, 0, up[6] or part == 1, scope])
        close(1)
        flush()
        leave()
        return hidden


_SIGNED = lambda x: x - (1 << 64) if x >= 1 << 63 else x


def _parsed(batches):
    """page_id, url, host, html to the same without html, with key, blocks and tree. key: the hash of the longest text."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    block = pa.list_(pa.struct([("node", pa.int64()), ("inside", pa.bool_()), ("text", pa.string()), ("h", pa.int64())]))
    node = pa.list_(pa.struct([("node", pa.int64()), ("above", pa.list_(pa.int64())), ("inside", pa.bool_()), ("hinted", pa.bool_()), ("style", pa.int64())]))
    for batch in batches:
        keys, rows, trees = [], [], []
        for host, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = Page(host, html)
            # The host's own name says nothing about a page.
            found = [(n, i, t, _SIGNED(xxh64_intdigest(t.replace(host, "") if host else t))) for n, i, t in page.blocks]
            keys.append(max(found, key=lambda b: (len(b[2]), b[3]))[3] if found else 0)
            rows.append([{"node": _SIGNED(n), "inside": i, "text": t, "h": h} for n, i, t, h in found])
            trees.append([{"node": _SIGNED(n), "above": list(map(_SIGNED, above)), "inside": i, "hinted": k, "style": _SIGNED(s)} for n, (above, i, k, s) in page.tree.items()] if found else [])
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(keys, pa.int64()), pa.array(rows, block), pa.array(trees, node)], names=["page_id", "url", "host", "key", "blocks", "tree"])


def host_name(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """node, host, above, inside, hinted, pages, presentation, styles, content, weight, branch, top, composite: the merged trees of all hosts.

    pages: host, key, blocks, tree. Pages with the same longest text are copies or near copies; they tell about one text and nothing
    about the template, so they count as one page, their key. content: the importance of the node's own texts (null without any),
    weight: how often they occur; branch and top: the weighted mean and the greatest of content in the whole branch, of nodes with
    MIN_PAGES pages or more (null without such). Counts are merged before they are dealt out, so a host with a third of all pages sends a row per text and task.
    """
    part = pages.select("host", "key", F.explode("tree").alias("t")).select("host", "key", "t.*")
    nodes = part.select("node", "host", "above", "inside", "hinted").dropDuplicates(["node"])
    xlogx = lambda n: n * F.log(n)
    shape = part.select("node", "style", "key").distinct().groupBy("node", "style").agg(F.count("*").alias("n"))
    shape = shape.groupBy("node").agg(F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(xlogx(F.col("n"))).alias("s"))
    vary = F.when(F.col("pages") > 1, 1 - F.col("s") / xlogx(F.col("pages"))).otherwise(1.0)
    shape = shape.select("node", "pages", "styles", vary.alias("presentation"))
    texts = pages.select("key", F.explode("blocks").alias("b")).select("b.node", "b.h", "key").distinct().groupBy("node", "h").agg(F.count("*").alias("n"))
    texts = texts.groupBy("node").agg(F.sum("n").alias("weight"), F.sum(xlogx(F.col("n"))).alias("s"))
    alone = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("weight") * F.log("pages"))).when(F.col("weight").isNotNull(), 1.0)
    all_ = nodes.join(shape, "node").join(texts, "node", "left").withColumn("content", alone).drop("s")
    all_ = keep(all_, "style-nodes")
    beneath = all_.where(F.col("content").isNotNull() & (F.col("pages") >= MIN_PAGES)).select(F.explode(F.array_append("above", F.col("node"))).alias("node"), "content", "weight")
    beneath = beneath.groupBy("node").agg((F.sum(F.col("content") * F.col("weight")) / F.sum("weight")).alias("branch"), F.max("content").alias("top"))
    own = F.pow(F.lit(STYLE_DECAY), "styles")
    return all_.join(beneath, "node", "left").withColumn("composite", (1 - own) * F.col("presentation") + own * F.col("branch"))


def judged_nodes(pages: DataFrame) -> DataFrame:
    """host, node, low: nodes with texts that are to be removed (low) or, if the tree can judge them, kept (not low).

    A node with MIN_PAGES pages or more is judged by the importance of its own texts; a rarer one goes with the nearest branch
    above it that is judged, if that is noise through and through. A node in a part whose name hints at no article is low unless it
    stands inside an article, is judged and comes to HINTED.
    """
    tree = keep(style_tree(pages), "style-tree")
    least = F.when(F.col("hinted"), F.when(F.col("inside"), HINTED).otherwise(2.0)).when(F.col("inside"), INSIDE).otherwise(OUTSIDE)
    known = F.col("pages") >= MIN_PAGES
    own = tree.where(known & F.col("content").isNotNull()).select("host", "node", (F.col("content") < least).alias("low"))
    noise = tree.where(known & F.col("composite").isNotNull()).select(F.col("node").alias("up"), ((F.col("composite") < least) & (F.col("top") < least)).alias("noise"))
    rare = tree.where(~known & F.col("content").isNotNull()).select("host", "node", F.posexplode("above").alias("depth", "up"))
    rare = rare.join(noise, "up").groupBy("host", "node").agg(F.max_by("noise", "depth").alias("low")).where("low")
    hinted = tree.where(~known & F.col("hinted") & F.col("content").isNotNull()).select("host", "node", F.lit(True).alias("low"))
    return own.unionByName(rare.unionByName(hinted).distinct())


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html has an empty text. Pages give all blocks that their host's style tree does not remove. Blocks that it
    cannot judge are kept, but for those outside of the article or main elements of a page if these hold half of its text or
    more. A box is never most of an article: where the nodes that are to go hold half of the text inside, the article is one of many
    near copies, and stays if it is most of the page. Blocks are joined by a line feed in page order. A null url has an empty host; its pages are merged like
    those of any host. Repeated rows are treated alike. Further columns are not read.
    """
    slim = pages.select("page_id", "url", host_name(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    kind = (
        f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, key bigint, blocks array<struct<node:bigint,inside:boolean,text:string,h:bigint>>, "
        "tree array<struct<node:bigint,above:array<bigint>,inside:boolean,hinted:boolean,style:bigint>>"
    )
    parsed = keep(slim.mapInArrow(_parsed, kind).withColumn("row", F.monotonically_increasing_id()), "parsed-pages")
    judged = keep(judged_nodes(parsed), "judged-nodes")
    lists = [F.collect_list(F.when(c, F.col("node"))).alias(k) for k, c in (("low", F.col("low")), ("high", ~F.col("low")))]
    df = parsed.select("row", "page_id", "url", "host", F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["inside"].alias("inside"), b["text"].alias("text"))).alias("blocks"))
    if small(judged, BROADCAST_NODES):
        df = df.join(F.broadcast(judged.groupBy("host").agg(*lists)), "host", "left")
    else:
        at = parsed.select("row", F.explode(F.array_distinct("blocks.node")).alias("node")).join(judged.select("node", "low"), "node")
        df = df.join(at.groupBy("row").agg(*lists), "row", "left")
    among = lambda nodes, b: F.coalesce(F.array_contains(nodes, b["node"]), F.lit(False))
    chars = lambda of: F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + of(b) * F.length(b["text"]))
    df = df.withColumns(
        {
            "marked": chars(lambda b: F.when(b["inside"], 1).otherwise(-1)) >= 0,
            "copied": chars(lambda b: F.when(~b["inside"], 0).when(among("low", b), 1).otherwise(-1)) >= 0,
        }
    )
    wanted = lambda b: F.when(b["inside"], ~among("low", b) | (F.col("copied") & F.col("marked"))).otherwise(among("high", b) | (~among("low", b) & ~F.col("marked")))
    text = F.array_join(F.transform(F.filter("blocks", wanted), lambda b: b["text"]), "\n")
    return df.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_site_style_tree(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_site_style_tree": op9_site_style_tree}
ORACLE_SQL = {}
