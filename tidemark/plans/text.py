"""Text operators on documents, pages and names; maps, arrays and JSON."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import text as X
from tidemark.operators import terms
from tidemark.operators.sequence import previous_keys
from tidemark.plans.registry import Registry, n, r6

R = Registry()


def _quoted(p):
    return p.replace("'", "''")


@R.query("html_to_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<!--[^>]*-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(t):
    return t.pages.select("page_id", X.strip_html(F.col("html")).alias("text"))


@R.query("section_cut")
def section_cut(t):
    """Passages from a line that starts with a licence's or a sentence's opening to the next such line."""
    cut = X.cut_sections({"licence": r"(?m)^(Licensed|Released|This work)\b", "the": r"(?m)^The\b"})
    return t.documents.select("doc_id", cut("text").alias("s")).select("doc_id", F.explode("s").alias("section", "passage")).select("doc_id", "section", n(F.length("passage")).alias("chars"))


_ALL = {**X.DISCLOSURE, "licence": r"(?i)licensed under", "mail": r"\w@\w"}


@R.query("text_flags", f"SELECT doc_id, {', '.join(f'''regexp_matches(text, '{_quoted(p)}')::BIGINT AS {k}''' for k, p in _ALL.items())}, round(log10(1 + length(text)), 6) AS size FROM documents")
def text_flags(t):
    return t.documents.select("doc_id", *[v.alias(k) for k, v in X.flags(F.col("text"), _ALL).items()], r6(F.log10(1 + F.length("text"))).alias("size"))


_MORE = {**X.WEAKNESS, "capitals": r"(^|[ \n])[A-Z]{5,}", "stretch": r"(\w)\w?!!"}


@R.query("text_flags2", f"SELECT doc_id, {', '.join(f'''regexp_matches(text, '{_quoted(p)}')::BIGINT AS {k}''' for k, p in _MORE.items())} FROM documents")
def text_flags2(t):
    f = {k: v for k, v in X.flags(F.col("text"), _MORE).items()}
    return t.documents.select("doc_id", *[v.alias(k) for k, v in f.items()])

# RE2 has no look-ahead, so what needs one is tested by hand only.
_TOLD = [k for k in X.ITEM_PATTERNS if k != "icfr_changed"]


def _told(k):
    p = _quoted(X.ITEM_PATTERNS[k])
    if k == "auditor_tenure":
        since = f"try_cast(regexp_extract(text, '{p}', 2) AS INT)"
        return f"CASE WHEN {since} > 1900 AND {since} <= 2024 THEN 2024 - {since} END::BIGINT AS {k}"
    return f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {k}" if k.endswith(("_n", "_count")) else f"regexp_matches(text, '{p}')::BIGINT AS {k}"


@R.query(
    "block_item_flags",
    f"""SELECT doc_id, {', '.join(f"regexp_matches(text, '{_quoted(X.WEAKNESS[k])}')::BIGINT AS {k}" for k in X.WEAKNESS_KINDS)}, ({' + '.join(f"regexp_matches(text, '{_quoted(X.WEAKNESS[k])}')::BIGINT" for k in X.WEAKNESS_KINDS)})::BIGINT AS mw_types_n,
    {', '.join(_told(k) for k in _TOLD)}, round(log10(1 + length(text)), 6) AS len_9a FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
)
def block_item_flags(t):
    """The disclosures of an annual report; a text stands for each of its items, but is repeated nowhere."""
    f = X.item_flags(dict.fromkeys(("1", "1A", "3", "5", "7", "8", "9A", "9B"), F.col("text")), F.lit(2024))
    return t.documents.select("doc_id", *[(r6(c) if k == "len_9a" else c).alias(k) for k, c in f.items() if k != "icfr_changed"])


_SYL = "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN ends_with(w, 'e') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"


@R.query(
    "text_stats",
    f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), s AS (SELECT *, greatest(1, len(regexp_extract_all(text, '[.?!] '))) AS s, len(list_filter(w, lambda w: {_SYL} >= 3)) AS c FROM w WHERE len(w) >= 50)
    SELECT doc_id, len(w)::BIGINT AS n_words, round(len(w) / s, 6) AS avg_sentence, round(0.4 * (len(w) / s + 100 * c / len(w)), 6) AS fog, round(len(regexp_extract_all(text, '[0-9]')) / length(text), 6) AS digits, round(len(list_distinct(w)) / len(w), 6) AS distinct_share FROM s""",
)
def text_stats(t):
    # A run of vowels becomes a, one of consonants b, a last e E (silent, no group of its own): so no pattern has to repeat a group.
    lower = F.lower("text")
    runs = lower
    for pattern, sign in ((r"e(?![a-z])", "E"), ("[aeiouy]+", "a"), ("[b-df-hj-np-tv-xz]+", "b")):
        runs = F.regexp_replace(runs, pattern, sign)
    three, silent = r"(?<![abE])b?abab[aE][abE]*", r"(?<![abE])b?ababa?E(?![abE])"
    d = t.documents.select("doc_id", "text", F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= 50)
    d = d.withColumns({"s": F.greatest(F.lit(1), F.regexp_count("text", F.lit("[.?!] "))), "c": F.regexp_count(runs, F.lit(three)) - F.regexp_count(runs, F.lit(silent)), "k": F.size("w")})
    return d.select("doc_id", n("k").alias("n_words"), r6(F.col("k") / F.col("s")).alias("avg_sentence"), r6(0.4 * (F.col("k") / F.col("s") + 100 * F.col("c") / F.col("k"))).alias("fog"), r6(F.regexp_count("text", F.lit("[0-9]")) / F.length("text")).alias("digits"), r6(F.size(F.array_distinct("w")) / F.col("k")).alias("distinct_share"))


_LISTS = X.WORD_LISTS | {"common": "the and of in la le de et der die und el que"}
_RATES = ", ".join(f"round(len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in part.split())}))) / len(w), 6) AS {name}_rate" for name, part in _LISTS.items())


@R.query(
    "text_measures",
    f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g') AS t FROM documents), w AS (SELECT *, lower(t) AS low, regexp_extract_all(lower(t), '[a-z][a-z''-]+') AS w, greatest(1, len(regexp_extract_all(t, '[.?!] '))) AS s FROM t),
    c AS (SELECT *, len(list_filter(w, lambda w: {_SYL} >= 3)) AS c, strpos(low, ' the ') AS a FROM w WHERE len(w) >= 500), p AS (SELECT *, CASE WHEN a > 0 THEN strpos(low[a:], '. ') ELSE 0 END AS b FROM c)
    SELECT doc_id, len(w)::BIGINT AS n_words, round(log10(len(w)), 6) AS log_words, round(len(w) / s, 6) AS avg_sentence, round(c / len(w), 6) AS pct_complex, round(0.4 * (len(w) / s + 100 * c / len(w)), 6) AS fog, {_RATES},
    round(len(regexp_extract_all(t, '[0-9]')) / length(t), 6) AS number_density, round(CASE WHEN b > 1 THEN (b - 1) / length(low) ELSE 0 END, 6) AS section_share, round(len(list_distinct(w)) / len(w), 6) AS unique_ratio FROM p""",
)
def text_measures(t):
    """All measures of texts of 500 words or more; the section is what follows a first article up to the end of its sentence."""
    m = X.measures(F.col("text"), _LISTS, (" the ", ". "))
    whole = {"n_words"}
    x = t.documents.select("doc_id", *[c.alias(k) for k, c in m.items()]).where("n_words >= 500")
    return x.select("doc_id", *[n(k).alias(k) if k in whole else r6(k).alias(k) for k in m])


@R.query("tone", f"SELECT doc_id, round(1000.0 * len(regexp_extract_all(text, '{X.POSITIVE}')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z]{{2,}}'))), 6) AS pos, round(1000.0 * len(regexp_extract_all(text, '{X.NEGATIVE}')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z]{{2,}}'))), 6) AS neg FROM documents")
def tone(t):
    return t.documents.select("doc_id", r6(X.per_thousand(F.col("text"), X.POSITIVE)).alias("pos"), r6(X.per_thousand(F.col("text"), X.NEGATIVE)).alias("neg"))


_BAG = "SELECT doc_id, source, w, count(*) AS c FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY ALL"


@R.query(
    "bow_cosine",
    f"""WITH b AS ({_BAG}), q AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM b GROUP BY 1), p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents),
    d AS (SELECT p.doc_id, p.prev, sum(x.c * y.c) AS dot FROM p JOIN b x ON x.doc_id = p.doc_id JOIN b y ON y.doc_id = p.prev AND y.w = x.w GROUP BY 1, 2)
    SELECT d.doc_id, d.prev, round(dot / (a.norm * e.norm), 6) AS cosine FROM d JOIN q a ON a.doc_id = d.doc_id JOIN q e ON e.doc_id = d.prev""",
)
def bow_cosine(t):
    """The cosine of a document's word counts with those of the source's previous one. The counts are made in the row, and pairs of a
    document and the one before it meet by the later one's id, so a source with a third of all rows is spread over all tasks."""
    d = t.documents.select("doc_id", "source", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    d = d.select("doc_id", _counted("w").alias("bag"))
    pairs = previous_keys(t.documents.select("doc_id", "source"), "source", "doc_id")
    x = pairs.join(d.select("doc_id", "bag"), "doc_id").join(d.select(F.col("doc_id").alias("prev"), F.col("bag").alias("before")), "prev")
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, c: a + c * c))
    # Words that both have are neighbours once the two bags are sorted into one.
    both = F.sort_array(F.concat(F.map_entries("bag"), F.map_entries("before")))
    shared = lambda a: F.filter(F.transform(a, lambda e, i: F.when(e["key"] == F.get(a, i - 1)["key"], (e["value"] * F.get(a, i - 1)["value"]).cast("double"))), lambda v: v.isNotNull())
    dot = F.aggregate(F.transform(F.array(both), shared)[0], F.lit(0.0), lambda a, v: a + v)
    # Exploded from an array of one, so that the filter does not compute it again; bags without words give null.
    cosine = F.filter(F.array(dot / (norm("bag") * norm("before"))), lambda v: v > 0)
    return x.select("doc_id", "prev", F.explode(cosine).alias("cosine")).withColumn("cosine", r6("cosine"))


def _counted(words: str):
    """A map of each word of an array to how often it occurs: the words in order, of which the places where a new one begins are told apart."""
    w = F.sort_array(words)
    begin = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
    made = lambda a: F.transform(F.array(begin(a)), lambda b: F.map_from_arrays(F.transform(b, lambda i: F.get(a, i)), F.transform(b, lambda i, j: F.coalesce(F.get(b, j + 1), F.size(a)) - i)))[0]
    return F.when(F.size(words) > 0, F.transform(F.array(w), made)[0])


@R.query("len_ratio", "SELECT doc_id, round(length(text) / nullif(lag(length(text)) OVER (PARTITION BY source ORDER BY doc_id), 0), 6) AS ratio FROM documents")
def len_ratio(t):
    # Lengths are joined, texts are not.
    k = t.documents.select("doc_id", F.length("text").alias("k"))
    x = k.join(previous_keys(t.documents.select("doc_id", "source"), "source", "doc_id"), "doc_id", "left")
    x = x.join(k.select(F.col("doc_id").alias("prev"), F.col("k").alias("before")), "prev", "left")
    return x.select("doc_id", r6(F.try_divide("k", "before")).alias("ratio"))


_PICKS = [(r"(?i)licen[cs]e", 2), (r"[0-9]", 2), (r"(?i)\bthe\b", 3)]
_FIT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 40 AND 600)"


@R.query(
    "digest",
    f"""WITH f AS (SELECT doc_id, {_FIT} AS f FROM documents), p AS (SELECT doc_id, list_concat({", ".join(f"list_slice(list_filter(f, lambda s: regexp_matches(s, '{p}')), 1, {k})" for p, k in _PICKS)}) AS p FROM f),
    u AS (SELECT doc_id, list_filter(p, lambda s, i: list_position(p, s) = i) AS u FROM p) SELECT doc_id, array_to_string(list_slice(string_split(array_to_string(u, ' '), ' '), 1, 60), ' ') AS digest FROM u""",
)
def digest(t):
    return t.documents.select("doc_id", X.digest(F.col("text"), _PICKS, words=60).alias("digest"))


_FEE_LINES = {1: ("audit", "Audit fees"), 2: ("related", "Audit-related fees"), 3: ("tax", "Tax fees"), 4: ("other", "All other fees")}


def _fee_sql(part: str, of: str) -> str:
    return f"max(CASE WHEN l_linenumber = {part} THEN {of} END)"


_NOW, _PRIOR = "floor(l_extendedprice)", "floor(l_quantity * 1000 + l_partkey % 1000)"


@R.query(
    "fee_parse",
    f"""WITH f AS (SELECT l_orderkey, {", ".join(f"{_fee_sql(i, _NOW)} AS {k}, {_fee_sql(i, _PRIOR)} AS {k}_prior" for i, (k, _) in _FEE_LINES.items())} FROM lineitem GROUP BY 1)
    SELECT l_orderkey, audit, {", ".join(f"CASE WHEN audit IS NOT NULL THEN {k} END AS {k}" for k in ("related", "tax", "other"))}, audit + coalesce(related, 0) + coalesce(tax, 0) + coalesce(other, 0) AS total, audit_prior, audit_prior + coalesce(related_prior, 0) + coalesce(tax_prior, 0) + coalesce(other_prior, 0) AS total_prior FROM f""",
)
def fee_parse(t):
    """Fee tables are read back from reports that are written from an order's lines, after a mention of fees in prose."""
    cell = lambda c: F.format_number(c, 0)
    line = lambda c, i: F.max(F.when(F.col("l_linenumber") == i, c))
    now, prior = F.floor("l_extendedprice"), F.floor(F.col("l_quantity") * 1000 + F.col("l_partkey") % 1000)
    # One shuffle: an order's lines are columns, null where it has none.
    orders = t.lineitem.groupBy("l_orderkey").agg(*[line(c, i).alias(f"{k}{i}") for i in _FEE_LINES for k, c in (("has", F.lit(1)), ("now", now), ("prior", prior))])
    row = lambda i, name: F.when(F.col(f"has{i}") == 1, F.concat_ws(" ", F.lit(name), F.concat(F.lit("$ "), cell(f"now{i}")), cell(f"prior{i}")))
    some = F.greatest(*[F.col(f"has{i}") for i in _FEE_LINES]) == 1
    rows = orders.select("l_orderkey", F.when(some, F.concat_ws("\n", *[row(i, name) for i, (_, name) in _FEE_LINES.items()])).alias("rows"))
    text = F.concat(F.lit("The committee approved all audit fees of 2001 in advance.\nFees 2001 2000\n"), F.col("rows"), F.lit("\nSee note 12 on total assets of 2001."))
    # Orders without a first line have no audit fees, so their table is none.
    f = rows.select("l_orderkey", X.fees(text).alias("f"))
    names = ("audit", "related", "tax", "other", "total", "audit_prior", "total_prior")
    return f.select("l_orderkey", *[F.col(f"f.{k}").alias(k) for k in names])


@R.query("extract_years", r"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(url, '[0-9]{4}')::BIGINT[], lambda y: y BETWEEN 1005 AND 8026)))::VARCHAR[], ',') AS years FROM pages")
def extract_years(t):
    found = F.transform(F.regexp_extract_all("url", F.lit("[0-9]{4}"), F.lit(0)), lambda y: y.cast("long"))
    years = F.sort_array(F.array_distinct(F.filter(found, lambda y: y.between(1005, 8026))))
    return t.pages.select("page_id", F.array_join(years.cast("array<string>"), ",").alias("years"))


@R.query("normalise_name", r"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'), '\b(inc|corp|co|ltd|llc|plc|customer)\b', '', 'g')) AS name FROM customer")
def normalise_name(t):
    return t.customer.select("c_custkey", F.trim(F.regexp_replace(F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", " "), r"\b(inc|corp|co|ltd|llc|plc|customer)\b", "")).alias("name"))


@R.query("id_extract", r"SELECT c_custkey, lpad(ltrim(regexp_extract(c_name, '([0-9]+)$', 1), '0'), 12, '0') AS id FROM customer")
def id_extract(t):
    return t.customer.select("c_custkey", F.lpad(F.ltrim(F.regexp_extract("c_name", "([0-9]+)$", 1), F.lit("0")), 12, "0").alias("id"))


@R.query("signature_date", "SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_shipdate::DATE - o_orderdate::DATE BETWEEN 0 AND 60 THEN strftime(l_shipdate, '%Y-%m-%d') END AS signed FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def signature_date(t):
    """The first date near the end of a text that lies within some days after another date."""
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat(F.lit("agreed January 1 1990 and signed on "), F.date_format("l_shipdate", "MMMM d yyyy"), F.lit(" by us"))
    found = F.regexp_extract_all(F.substring(text, -30000, 30000), F.lit(r"[A-Z][a-z]+ \d{1,2} \d{4}"), F.lit(0))
    dates = F.filter(F.transform(found, S.parse_date), lambda d: F.datediff(d, F.col("o_orderdate").cast("date")).between(0, 60))
    return j.select("l_orderkey", n("l_linenumber").alias("line"), F.date_format(F.get(dates, F.lit(0)), "yyyy-MM-dd").alias("signed"))


@R.query("feature_words", "SELECT event_id, CASE event_type WHEN 'error' THEN 'a failure' WHEN 'click' THEN 'a click' WHEN 'view' THEN 'a view' WHEN 'signup' THEN 'a new account' ELSE event_type END || CASE WHEN value > 100 THEN ', large' ELSE '' END AS words FROM events")
def feature_words(t):
    names = F.create_map(*[F.lit(x) for x in ("error", "a failure", "click", "a click", "view", "a view", "signup", "a new account")])
    return t.events.select("event_id", F.concat(F.coalesce(F.try_element_at(names, F.col("event_type")), "event_type"), F.when(F.col("value") > 100, ", large").otherwise("")).alias("words"))


@R.query(
    "tfidf",
    f"""WITH b AS ({_BAG}), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT w, count(*) AS df FROM b GROUP BY 1), s AS (SELECT doc_id, w, round((1 + ln(c)) * (ln((1 + n.n) / (1 + df)) + 1), 6) AS s FROM b JOIN d USING (w), n WHERE df >= 5 AND df <= 0.9 * n.n)
    SELECT doc_id, w AS term, s AS weight FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, w) <= 3""",
)
def tfidf(t):
    """Words are counted in their row first; the three best of a document are a partial maximum and no window."""
    w = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    bag = w.select("doc_id", F.explode(_counted("w")).alias("w", "c"))
    total = F.broadcast(t.documents.agg(F.count("*").alias("n")))
    df = bag.groupBy("w").agg(F.count("*").alias("df")).crossJoin(total).where("df >= 5 and df <= 0.9 * n")
    s = bag.join(df, "w").withColumn("weight", r6((1 + F.log("c")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)))
    best = s.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "w"))), 1, 3).alias("b"))
    return best.select("doc_id", F.explode("b").alias("b")).select("doc_id", F.col("b.w").alias("term"), (-F.col("b.minus")).alias("weight"))


@R.query(
    "tfidf_bigrams",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents), b AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w) GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM b GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT n FROM n) ORDER BY sum(c) DESC, term LIMIT 3000),
    s AS (SELECT doc_id, term, (1 + ln(c)) * (ln((1 + n.n) / (1 + df)) + 1) AS s FROM b JOIN d USING (term), n)
    SELECT doc_id, count(*)::BIGINT AS n_terms, round(sum(s) / sqrt(sum(s * s)), 5) AS total, round(max(s) / sqrt(sum(s * s)), 6) AS heaviest FROM s GROUP BY 1""",
)
def tfidf_bigrams(t):
    """Weights of words and pairs of words; of the terms in five documents or more and nine tenths at most, the 3,000 most frequent."""
    x = terms.tfidf(t.documents, "doc_id", "text", cap=3000)
    total = F.aggregate("terms", F.lit(0.0), lambda a, e: a + e["weight"])
    return x.select("doc_id", n(F.size("terms")).alias("n_terms"), F.round(total, 5).alias("total"), r6(F.get("terms", F.lit(0))["weight"]).alias("heaviest"))


@R.query("string_basic", "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, contains(lower(c_mktsegment), 'build')::BIGINT AS build FROM customer")
def string_basic(t):
    return t.customer.select("c_custkey", F.initcap("c_mktsegment").alias("title"), n(F.lower("c_mktsegment").contains("build")).alias("build"))


@R.query("map_ops", "SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS clicks, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY 1")
def map_ops(t):
    per = t.events.groupBy("user_id", "event_type").agg(n(F.count("*")).alias("c"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("m"))
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"), n(F.size("m")).alias("kinds"))


@R.query("array_ops", "SELECT vec_id, round(list_sum(e), 3) + 0 AS total, round(list_max(e), 5) AS top, (list_position(e, list_max(e)))::BIGINT AS argmax, round(list_dot_product(e[1:4], e[5:8]), 4) + 0 AS dot FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def array_ops(t):
    e = F.col("embedding").cast("array<double>")
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    dot = F.aggregate(F.zip_with(F.slice(e, 1, 4), F.slice(e, 5, 4), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", (F.round(total, 3) + F.lit(0.0)).alias("total"), F.round(F.array_max(e).cast("double"), 5).alias("top"), n(F.array_position(e, F.array_max(e))).alias("argmax"), (F.round(dot, 4) + F.lit(0.0)).alias("dot"))


@R.query("json_roundtrip", "SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_roundtrip(t):
    js = F.to_json(F.struct(F.col("event_type").alias("t"), F.from_json("props", "k long").alias("p")))
    return t.events.select("event_id", F.from_json(js, "t string, p struct<k: long>").alias("j")).select("event_id", "j.t", "j.p.k")


QUERIES, ORACLE_SQL = R.queries, R.sql
