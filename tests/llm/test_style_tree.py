"""The style tree against a plain computation with dictionaries, and pages that try the parser."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from tidemark.llm import html_extract as H
from tests.llm.test_learned import page


def site(seed=3):
    """Pages of two hosts: a menu without telling names, boxes inside and beside the main text, near copies, rare elements in menus."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["lin", "mor", "ther", "and"]) + str(r.randrange(999)) for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        rare = f"<div class='tile'><ul class='{'abcdefgh'[i % 8]}{'uvwxyz'[i // 8]}'><li>Today</li></ul></div>" if i % 8 < 3 else ""
        menu = f"<div class='tiles'><div><ul><li>Start</li><li>News</li><li>About</li></ul></div>{rare}</div>"
        body = [words(12) for _ in range(r.randint(1, 5))]
        shared = ["A passage that all articles of the site have."]
        rows.append((i, f"http://one.org/{i}", page(f"{menu}<div class='text'>{''.join(f'<p>{x}</p>' for x in body + shared)}<div class='box'>Call us today</div></div>")))
        want[i] = "\n".join(body + shared)
    story = [words(20), words(30), words(20)]
    for i in range(30, 60):
        story[0] = words(20)
        rows.append((i, f"http://two.org/{i}", page(f"<article>{''.join(f'<p>{x}</p>' for x in story)}</article><div class='x'>Welcome {i % 2}</div>")))
        want[i] = "\n".join(story)
    return rows, want


def by_hand(rows):
    """Importances of all nodes by the definitions, page by page."""
    pages, above = defaultdict(set), {}
    texts, shown = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    from xxhash import xxh64_intdigest as digest

    for _, url, html in rows:
        host = url.split("/")[2]
        p = H.Page(host, html)
        if not p.blocks:
            continue
        key = max((len(t), H._SIGNED(digest(t.replace(host, ""))), t) for _, _, t in p.blocks)[2]
        for node, (chain, _, _, style) in p.tree.items():
            above[node] = chain
            shown[node][style].add(key)
            pages[node].add((style, key))
        for node, _, t in p.blocks:
            texts[node][t].add(key)
    content, weight = {}, {}
    for node, of in texts.items():
        m = len(pages[node])
        n = [len(k) for k in of.values()]
        weight[node] = sum(n)
        content[node] = 1 - sum(x * math.log(x) for x in n) / (sum(n) * math.log(m)) if m > 1 else 1.0
    out = {}
    for node in pages:
        under = [x for x in content if (x == node or node in above[x]) and len(pages[x]) >= H.MIN_PAGES]
        m = len(pages[node])
        n = [len(k) for k in shown[node].values()]
        vary = -sum(x / m * math.log(x / m) for x in n) / math.log(m) if m > 1 else 1.0
        branch = sum(content[x] * weight[x] for x in under) / sum(weight[x] for x in under) if under else None
        own = H.STYLE_DECAY ** len(n)
        out[H._SIGNED(node)] = (m, vary, content.get(node), branch, (1 - own) * vary + own * branch if under else None)
    return out


def parsed(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kind = "page_id long, url string, host string, key long, blocks array<struct<node:bigint,inside:boolean,text:string,h:bigint>>, tree array<struct<node:bigint,above:array<bigint>,inside:boolean,hinted:boolean,style:bigint>>"
    return df.select("page_id", "url", H.host_name(df.url).alias("host"), "html").repartition(5).mapInArrow(H._parsed, kind)


def test_importances_by_hand(spark):
    rows, _ = site()
    got = {x.node: (x.pages, x.presentation, x.content, x.branch, x.composite) for x in H.style_tree(parsed(spark, rows)).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys() and len(want) > 20
    for node, x in want.items():
        assert [v is None for v in got[node]] == [v is None for v in x]
        assert [v for v in got[node] if v is not None] == pytest.approx([v for v in x if v is not None], abs=1e-9)


def test_branches_of_low_importance_go(spark):
    """Menus and boxes without telling names go, rare elements in a noisy branch with them; a passage that all pages share stays in its article."""
    rows, want = site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {x.page_id: x.text for x in H.extract(df).collect()}
    assert got == want
    judged = H.judged_nodes(parsed(spark, rows)).collect()
    assert {True, False} == {x.low for x in judged}
    limit, H.BROADCAST_NODES = H.BROADCAST_NODES, 0
    try:
        assert {x.page_id: x.text for x in H.extract(df).collect()} == want
    finally:
        H.BROADCAST_NODES = limit


def text_of(html):
    return [t for _, _, t in H.Page("h.org", html).blocks]


def test_markup_loses_no_text():
    assert text_of("<article><p title=it's>Hello</p><p>World</p><p>isn't it</p></article>") == ["Hello", "World", "isn't it"]
    assert text_of("<p a=\"x>y\">in</p><p b='q'>two<p title=\"unclosed>three</p>") == ["in", "two", "three"]
    assert text_of("<p>a<!-->b<!-- c -->d</ x>e<a href=x'>f</a> 1 < 2 <3 &lt;g&gt;") == ["abdef 1 < 2 <3 <g>"]
    assert text_of("<script>if(a<b){'</p>'}</script >x<style>y</style\n>z<textarea><p>no</textarea>") == ["xz"]
    assert text_of("<article><p class=share-price>12</p><div class=related-work>x</div><div class=share-buttons>no</div><p id=cookie-notice>no</article>") == ["12", "x"]
    assert text_of("</p></div></article>x<p>y</div>z") == ["x", "y", "z"]


def test_parts_by_name():
    firm = "ad ad-300x250 siteFooter footer--dark sidebar-left main-nav menu-item cookie-notice comment-list reader-comments share-buttons related-posts widget-area newsletter-signup top-banner book-comments"
    hints = "market-share time-share job-search book-replies text-widget footer-notes"
    others = "share-price related-work load header-image article-body commentary content post-12 main search-results downloads no-sidebar no-ads content-with-sidebar hasFooter"
    assert {n: H.part_by_name(n) for n in f"{firm} {hints} {others}".split()} == dict.fromkeys(firm.split(), 2) | dict.fromkeys(hints.split(), 1) | dict.fromkeys(others.split(), 0)


def test_names_hide_no_article():
    assert text_of("<div class=no-sidebar><article><p>in</article></div>") == ["in"]
    # A part that holds the only article is no part; one beside an article is.
    assert text_of("<div class=sidebar><p>x</p><article><p>in</article></div>") == ["in"]
    assert text_of("<article>story</article><div class=sidebar><article><p>teaser</article></div>") == ["story"]
    assert text_of("<aside><article><p>teaser</article></aside>y") == ["y"]


def test_tree_overrules_hints(spark):
    """Of two boxes with hinting names in an article, the one that is each page's own stays; where the tree cannot judge, both go."""
    r = random.Random(8)
    words = lambda n: " ".join(r.choice(["lin", "mor", "ther"]) + str(r.randrange(999)) for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        host = "few.org" if i < 3 else "many.org"
        story, own = words(30), words(8)
        rows.append((i, f"http://{host}/{i}", page(f"<article><p>{story}</p><section class='market-share'><p>{own}</p></section><div class='job-search'><p>Find work near you</p></div></article><div class='text-widget'>{words(5)}</div>")))
        want[i] = story if i < 3 else f"{story}\n{own}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {x.page_id: x.text for x in H.extract(df).collect()} == want


def test_broken_markup_in_linear_time():
    for html in ('<p class="x" ' * 60_000, '<a b="' * 60_000, "<p class='x>' " * 30_000 + ">", "<!x " * 100_000, "<? " * 100_000, "</ x" * 100_000, "<script></script " * 40_000, "<" * 400_000 + ">", '<p a="<b>' * 40_000):
        began = time.time()
        text_of("<p>start</p>" + html)
        assert time.time() - began < 4, html[:20]
    for html in ("<section><article>" + "<div>" * 30_000 + "</section>" * 30_000, "<center>" * 60_000 + "x", "<h1><li>" * 30_000):
        began = time.time()
        text_of(html)
        assert time.time() - began < 10, html[:20]
    assert text_of("<p>one <p title=\"x <i>two</i> <p>three") == ["one", "two", "three"]
    assert text_of("<p>a <b c=\"<p>d</p><p>e 1 < 2 and x<y") == ["a d", "e 1 < 2 and x<y"]
    assert text_of("<p>a</p>b<!-- c") == ["a", "b"]


def test_deep_and_odd_nesting_in_bounded_time():
    began = time.time()
    assert text_of("<div>" * 60_000 + "deep" + "</div>" * 60_000) == ["deep"]
    assert text_of("</p>" * 40_000 + "<div>" * 40_000 + "</ul>" * 40_000 + "x") == ["x"]
    long = H.Page("h.org", "<p>" + "word " * 400_000 + "</p>" + "<p class=a1>y" * 20_000)
    assert len(long.blocks) == 20_001 and len(long.tree) == 3
    assert time.time() - began < 30


def test_odd_rows(spark):
    rows = [(None, None, "<p>no id</p>"), (1, "http://h.org/1", None), (1, "http://h.org/1", None), (2, "http://h.org/2", ""), (3, "http://h.org/3", "<main><h1>Main</h1></main><section><p>more text beside it than in it</p></section>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as host", "2 as row", "3 as low")
    got = Counter((x.page_id, x.text, x.n_chars) for x in H.extract(df).collect())
    assert got == Counter({(None, "no id", 5): 1, (1, "", 0): 2, (2, "", 0): 1, (3, "Main\nmore text beside it than in it", 35): 1})
