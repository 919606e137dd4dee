"""Toxicity, language, HTML and the pipeline, on small made texts with known answers."""

import random
from html import escape

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_extract, language_id, toxicity


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(7)
    plain = [f"{a}{b}" for a in ("ther", "on", "hea", "lin", "mor") for b in ("an", "er", "st", "ou", "ing", "ed")]
    rude = ["stupid", "idiot", *[f"grukk{x}" for x in ("an", "er", "st", "ou", "ing", "ed", "le")]]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [r.choice(plain) for _ in range(r.randint(20, 150))]
        for _ in range(max(1, len(w) // 12) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(rude).upper() + "!")
        rows.append((i, " ".join(w), "src", 1.0))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(bad)))
    rows += [(2000, None, None, 1.0), (2001, "", None, 1.0), (None, "stupid idiot", None, 1.0), (4, rows[4][1], "src", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df.repartition(3), lab).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    held = [(x.predicted, x.doc_id % 4 == 0) for x in got if x.held_out and x.doc_id is not None and x.doc_id < 2000]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    assert all(x.predicted == 0 for x in got if x.doc_id in (2000, 2001))
    none = toxicity.score_toxicity(df, lab.limit(0)).collect()
    assert len(none) == len(rows)
    assert toxicity.score_toxicity(df.limit(0), lab).count() == 0


def test_label_model_by_dictionaries(spark):
    """Families, and expectation maximisation document by document instead of by groups of equal votes."""
    import math

    r = random.Random(21)
    voters, prior, docs = 6, 0.1, []
    for i in range(900):
        bad = i % 11 == 0
        votes = {k for k in range(voters) if r.random() < ((0.7, 0.5, 0.3, 0.2, 0.05, 0.4)[k] if bad else (0.01, 0.02, 0.01, 0.05, 0.05, 0.0)[k])}
        if 0 in votes and r.random() < 0.9:
            votes.add(5)  # fires along with the first one
        docs.append(sorted(votes | {voters + r.randrange(3)}))
    got = toxicity.label_model(spark.createDataFrame([(d,) for d in docs], "f array<int>").repartition(4), voters, prior)
    fired = [{k for k in d if k < voters} for d in docs]
    n = len(docs)
    up = list(range(voters))
    for a in range(voters):
        for b in range(a + 1, voters):
            x, y = sum(a in v for v in fired), sum(b in v for v in fired)
            both = sum(a in v and b in v for v in fired)
            if 2 * both >= x + y - both:
                up = [up[a] if u == up[b] else u for u in up]
    assert len(set(got[0])) == len(set(up)) < voters and all((got[0][i] == got[0][j]) == (up[i] == up[j]) for i in range(voters) for j in range(voters))
    states = [{got[0][k] for k in v} for v in fired]
    hits = {k: sum(k in s for s in states) for k in {k for s in states for k in s}}
    a = {k: min(0.5, max(1e-3, 0.7 * h / (prior * n))) for k, h in hits.items()}
    b = {k: max(1e-7, 0.1 * h / n) for k, h in hits.items()}
    pi, weight, none = prior, {}, 0.0
    for _ in range(toxicity.EM_STEPS):
        none = math.log(pi / (1 - pi)) + sum(math.log((1 - a[k]) / (1 - b[k])) for k in hits)
        weight = {k: math.log(a[k] / b[k]) - math.log((1 - a[k]) / (1 - b[k])) for k in hits}
        post = [1 / (1 + math.exp(-none - sum(weight[k] for k in s))) for s in states]
        toxic = sum(post)
        of = {k: sum(p for p, s in zip(post, states) if k in s) for k in hits}
        a = {k: min(0.9, max(1e-4, of[k] / (toxic + 1))) for k in hits}
        b = {k: min(a[k] / 2, max(1e-7, (h - of[k] + 0.1) / (n - toxic + 1))) for k, h in hits.items()}
        pi = min(0.5, max(1e-4, toxic / n))
    assert got[2] == pytest.approx(none, rel=1e-6) and got[1] == pytest.approx(weight, rel=1e-6)
    # The model tells toxic rows from clean ones although it has seen no label.
    told = [none + sum(weight[k] for k in s) > 0 for s in states]
    assert sum(t == (i % 11 == 0) for i, t in enumerate(told)) / n > 0.93


def test_mined_features_by_dictionaries(spark):
    import math
    from collections import Counter

    r = random.Random(22)
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(["lin", "morning", "therapy", "ander"]) for _ in range(12)]
        if i % 5 == 0:
            w += [r.choice(["grukkan", "grukkel", "Idiot"]) for _ in range(2)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    voters, used = toxicity.mine(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    seen = {0: Counter(), 1: Counter()}
    for (_, t), (_, y) in zip(rows, labels):
        seen[y].update({f for w in t.lower().split() for f in toxicity.word_features(w)})
    lift = {f: (seen[1][f] / 80) / ((seen[0][f] + 0.5) / 320) for f in seen[1]}
    want = {f for f, p in seen[1].items() if p >= toxicity.USED_SUPPORT and lift[f] >= toxicity.USED_LIFT}
    seeds = {f"w:{w}" for w in toxicity.SEED_WORDS}
    assert set(used) == want | seeds
    strong = {f for f in want if seen[1][f] >= toxicity.SUPPORT and lift[f] >= toxicity.LIFT and seen[1][f] * math.log(lift[f]) >= toxicity.EVIDENCE}
    assert set(voters) == strong | seeds and strong


def test_languages(spark):
    r = random.Random(8)
    parts = {"aa": "lin mor ther ing and", "bb": "ung keit ver ein über", "cc": "ción ñas que los ado"}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        w = ["".join(r.choice(parts[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(4, 60))]
        rows.append((i, " ".join(w).title(), lang if i % 10 else None))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "aa"), (903, "keitung verein", None), (None, "ciónque", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {x.doc_id: x for x in language_id.identify(df).collect()}
    assert all(got[i].lang_pred == sorted(parts)[i % 3] for i in range(240))
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"] and got[900].score == 0
    assert {x.lang_pred for x in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_code_lengths_by_hand():
    """The tables against the definition, byte by byte with dictionaries."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    texts = [b" abracadabra abba ", b" cabbage and a crab "]
    o = language_id.ORDER
    grams = Counter(int.from_bytes((b" " * (o - 1) + t)[i : i + o + 1], "big") for t in texts for i in range(len(t) - 1))
    g, n = np.array(list(grams)), np.array(list(grams.values()))
    trees = language_id.Trees({"x": (g, n)})
    cells = defaultdict(Counter)
    for v, c in grams.items():
        b = v.to_bytes(o + 1, "big")
        for d in range(o + 1):
            cells[b[o - d : o]][b[o]] += c

    def p(ctx, s):
        c = cells.get(ctx)
        below = (lambda: p(ctx[1:], s)) if ctx else (lambda: 1 / 256)
        if not c:
            return below()
        t, k = sum(c.values()), len(c)
        return c[s] / (t + k) if c[s] else k / (t + k) * below()

    data = b" " * (o - 1) + b" a crab and abba zzz \xc3\xa9\xff\x00 "
    want = sum(-math.log2(p(data[i - o : i], data[i])) for i in range(o, len(data)))
    bits, count = trees.lengths(data)
    assert count == len(data) - o and bits[0] == pytest.approx(want, rel=1e-5)


def test_code_lengths_of_all_bytes_and_many_trees():
    """Random trees over all 256 bytes side by side: each has the lengths that it has alone, by the definition."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    r = random.Random(12)
    texts = {f"l{k}": bytes(r.choice(r.sample(range(256), 256 if k % 2 else 9)) for _ in range(1500)) for k in range(5)}
    o = language_id.ORDER
    of = {k: Counter(int.from_bytes(t[i : i + o + 1], "big") for i in range(len(t) - o)) for k, t in texts.items()}
    trees = language_id.Trees({k: (np.array(list(c)), np.array(list(c.values()))) for k, c in of.items()})
    data = bytes(r.randrange(256) for _ in range(300)) + texts["l0"][:200] + texts["l1"][:200]
    bits, _ = trees.lengths(data)
    for j, k in enumerate(trees.langs):
        cells = defaultdict(Counter)
        for v, c in of[k].items():
            b = v.to_bytes(o + 1, "big")
            for d in range(o + 1):
                cells[b[o - d : o]][b[o]] += c

        def p(ctx, s):
            below = lambda: p(ctx[1:], s) if ctx else 1 / 256  # noqa: B023, E731
            c = cells.get(ctx)  # noqa: B023
            if not c:
                return below()
            t, kinds = sum(c.values()), len(c)
            return c[s] / (t + kinds) if c[s] else kinds / (t + kinds) * below()

        assert bits[j] == pytest.approx(sum(-math.log2(p(data[i - o : i], data[i])) for i in range(o, len(data))), rel=1e-5)


def test_any_number_of_languages(spark):
    """Sixty languages, in one block and in many: the same predictions, and scores that add up over all of them."""
    r = random.Random(13)
    parts = {f"x{k:02d}": ["".join(r.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(6)] for k in range(60)}
    rows = []
    for i in range(360):
        lang = sorted(parts)[i % 60]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(2)) for _ in range(15)), lang))
    rows += [(1000, None, "x00"), (1000, "", None), (None, " ".join(parts["x07"] * 3), None), (1001, "12 34", None), (1002, (parts["x11"][0] + " ") * 60_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as row", "2 as bits", "3 as id")
    kept = language_id.BLOCK_GRAMS, language_id.BLOCK_LANGUAGES
    got = {}
    try:
        for language_id.BLOCK_GRAMS, language_id.BLOCK_LANGUAGES in ((10**9, 100), kept, (3000, 7)):
            got[language_id.BLOCK_LANGUAGES] = sorted(((x.doc_id, x.held_out, x.lang_pred, round(x.score, 9)) for x in language_id.identify(df.repartition(3)).collect()), key=str)
    finally:
        language_id.BLOCK_GRAMS, language_id.BLOCK_LANGUAGES = kept
    assert got[100] == got[40] == got[7] and len(got[7]) == len(rows)
    by = {x[0]: x for x in got[7]}
    assert all(by[i][2] == sorted(parts)[i % 60] for i in range(360)) and by[None][2] == "x07" and by[1002][2] == "x11" and by[1000][2] == by[1001][2] == "und"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>';</script>{head}</head><body>{body}</body></html>"


def test_pages_with_an_article(spark):
    art = "<article><h1>A &amp; B</h1><p>One <b>two</b>\n three<br>four<p>Five<div class='share-buttons'>no</div><ul><li>x<li>y</ul><!-- c --><aside>no</aside><section class=comments><p>no</p></section></article>"
    html = page(f"<header>no</header><nav><ul><li><a href=/>no</a></ul></nav><div class='ad'>no</div>{art}<form>no<input></form><footer>&copy; no</footer>")
    rows = [(1, "http://h/1", html), (2, "http://h/2", None), (3, None, ""), (4, "x", "plain &lt;text&gt; only"), (5, "http://h/5", "<p>cut <b>off"), (1, "http://h/1", html), (6, "http://h/6", "<article></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {x.page_id: x.text for x in html_extract.extract(df).collect()}
    assert got[1] == "A & B\nOne two three four\nFive\nx\ny"
    assert got[2] == got[3] == got[6] == "" and got[4] == "plain <text> only" and got[5] == "cut off"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_site_tree_drops_what_repeats(spark):
    """Pages without article markup: what a host's pages repeat goes, what differs stays; a host of few pages keeps all."""
    r = random.Random(9)
    rows = []
    for i in range(40):
        own = " ".join(r.choice(["lin", "mor", "ther"]) + str(r.randrange(99)) for _ in range(12))
        rows.append((i, f"http://big.org/{i}", page(f"<div class='top'>Welcome all</div><div class='body'><p>{escape(own)}</p></div><div class='end'>Call us</div>")))
    rows.append((99, "http://small.org/1", page("<div class='top'>Welcome all</div><p>text</p>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extract.extract(df).collect()}
    assert all("Welcome" not in got[i] and "Call" not in got[i] and len(got[i].split()) == 12 for i in range(40))
    assert got[99] == "Welcome all\ntext"


def test_site_tree_judges_pages_with_an_article(spark):
    """An article that is only a teaser does not hide the main text beside it, and a box that all articles repeat goes."""
    r = random.Random(10)
    own = lambda n: " ".join(r.choice(["lin", "mor", "ther"]) + str(r.randrange(999)) for _ in range(n))
    main, rows = {}, []
    for i in range(20):
        main[i] = own(12)
        rows.append((i, f"http://beside.org/{i}", page(f"<article class='tile'><h2>Read this next</h2></article><div class='body'><p>{main[i]}</p></div>")))
        main[100 + i] = own(12)
        rows.append((100 + i, f"http://box.org/{i}", page(f"<div class='top'>Welcome</div><article><p>{main[100 + i]}</p><div class='box'>Call us today</div></article>")))
        main[200 + i] = "one story\nunder many addresses"
        rows.append((200 + i, f"http://copies.org/{i}", page("<article><h1>one story</h1><p>under many addresses</p></article>")))
    main[300] = "Teaser\n" + own(12)
    rows.append((300, "http://few.org/1", page(f"<article><p>Teaser</p></article><div>{main[300][7:]}</div>")))
    main[301] = own(12)
    rows.append((301, "http://few.org/2", page(f"<div class='x'>Welcome</div><article><p>{main[301]}</p></article>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_extract.extract(df).collect()} == main


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_near_duplicates import by_hand

    r = random.Random(11)
    word = lambda: "".join(r.choice(["lin", "mor", "ther", "an", "ou", "st"]) for _ in range(3))
    passage = " ".join(word() for _ in range(30))
    docs, labels, toxic, leaked = [], [], set(), set()
    for i in range(300):
        w = [word() for _ in range(r.randint(30, 90))]
        if i % 10 == 0:
            for _ in range(len(w) // 8):
                w.insert(r.randrange(len(w)), r.choice(["stupid", "idiot", "moron", "trash"]))
            toxic.add(i)
        elif i % 25 == 3:
            w[5:5] = passage.split()
            leaked.add(i)
        if i % 50 == 7:
            w.append("call +1 (017) 555-7713 now")
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 10 == 0)))
    docs += [(300 + i, docs[41][1] + (" end" if i % 2 else ""), "en", "s0", 0) for i in range(6)] + [(400, None, None, None, None), (12, docs[12][1], "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.keep(stage(spark, df, str(tmp_path)), name)
        seen[name] = df.collect()
    ids = {k: sorted(x.doc_id for x in v) for k, v in seen.items()}
    all_ids = sorted(d[0] for d in docs)
    assert ids["toxicity"] == [i for i in all_ids if i not in toxic]
    text = {d[0]: d[1] for d in docs}
    stay = {i for i, _, _, kept in by_hand([(i, text[i]) for i in set(ids["toxicity"])], 5, 80) if kept}
    assert ids["near_duplicates"] == sorted(stay)
    assert ids["decontamination"] == sorted(stay - leaked)
    assert ids["pii"] == ids["decontamination"] == ids["mixing"]
    assert not any("555-7713" in (x.text or "") for x in seen["pii"])
    assert list(seen["pii"][0].asDict()) == list(corpus_pipeline.COLUMNS)
    total = sum(x.size for x in seen["mixing"])
    assert abs(sum(x.taken for x in seen["mixing"]) - 1.5 * total) < 0.05 * total
    again = sorted((x.doc_id, x.taken) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert again == sorted((x.doc_id, x.taken) for x in seen["mixing"])
