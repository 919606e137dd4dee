"""Benchmark decontamination by spaced-seed hashing.

A mask picks some positions of a window of words and ignores the others; windows of a benchmark item and of a document that agree
on the picked words meet in a join of their hashes even where ignored words were changed. Around each hit the two texts are then
aligned and compared word by word, and the overlap counts if enough of the aligned words agree: those of a window of fixed flanks,
or of any window around the hit, which may have words put in or left out on either side. Short masks find the hits between changes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, let, sized, small, table

#: Picked positions are 1. All masks have the same span.
MASKS = ("11011001101", "10110111011")
SPAN = len(MASKS[0])
#: Masks for passages that words put in, left out or changed cut into pieces; with one span as well.
SHORT_MASKS = ("1101101", "1011011")
SHORT_SPAN = len(SHORT_MASKS[0])
#: Words compared on either side of a hit, the share of them that must agree, and how many must.
FLANK, SHARE, MATCHED = 10, 0.8, 10
#: Most words put in or left out at one place.
GAP = 2
#: Words on either side of a hit that its comparison can reach.
REACH = FLANK + GAP
#: Benchmark windows up to this many are sent to every executor.
BROADCAST_WINDOWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(df: DataFrame, *cols: str) -> DataFrame:
    """df has words; a row with pos, span and hash for each window of words and each mask.

    Positions are exploded first, so the hashes are computed in generated code and not inside a lambda.
    """
    starts = F.when(F.size("words") >= SHORT_SPAN, F.sequence(F.lit(0), F.size("words") - SHORT_SPAN))
    at = df.select(*{*cols, "words"}, F.explode(starts).alias("pos"))
    seeds = []
    for k, mask in enumerate(MASKS + SHORT_MASKS):
        seed = F.xxhash64(F.lit(k), *[F.get("words", F.col("pos") + j) for j, c in enumerate(mask) if c == "1"])
        seeds.append(F.struct(F.lit(len(mask)).alias("span"), F.when(F.col("pos") + len(mask) <= F.size("words"), seed).alias("hash")))
    return at.select(*cols, "pos", F.explode(F.array(*seeds)).alias("s")).select(*cols, "pos", "s.span", "s.hash").where("hash is not null")


def overlap(doc: Column, item: Column, at: Column, start: Column) -> Column:
    """Struct (compared, matched): the words around a hit at doc[at], item[start], as far as both texts reach."""
    back = F.least(F.lit(FLANK), at, start)
    length = F.least(back + SPAN + FLANK, F.size(doc) - at + back, F.size(item) - start + back)
    x, y = F.slice(doc, at - back + 1, length), F.slice(item, start - back + 1, length)
    same = F.aggregate(F.zip_with(x, y, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return F.struct(length.alias("compared"), same.alias("matched"))


def _same(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.when(a == b, 1).otherwise(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _outward(doc: Column, item: Column) -> Column:
    """The most words that agree within the first 0, 1, 2, ... aligned ones; null past the end. Both texts start at a hit and lead away from it.

    Up to GAP words may be put in or left out where the texts first differ; each counts as compared.
    """
    def ways(v: Column) -> Column:
        x, y = v["x"], v["y"]
        n = F.least(F.size(x), F.size(y))
        same = _same(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n))

        def with_gaps(a: Column) -> Column:
            run = F.coalesce(F.nullif(F.array_position(a, F.lit(0)).cast("int"), F.lit(0)) - 1, F.size(a))

            def gap(e: int) -> Column:
                i, j = run + max(e, 0), run + max(-e, 0)
                m = F.greatest(F.lit(0), F.least(F.size(x) - i, F.size(y) - j))
                return F.concat(F.array_repeat(F.lit(1), run), F.array_repeat(F.lit(0), abs(e)), _same(F.slice(x, i + 1, m), F.slice(y, j + 1, m)))

            return F.array(a, *[gap(e) for e in range(-GAP, GAP + 1) if e])

        return let(same, with_gaps)

    most = lambda w: F.transform(F.sequence(F.lit(0), F.lit(FLANK + GAP)), lambda k: F.array_max(F.transform(w, lambda a: F.when(F.size(a) >= k, _sum(F.slice(a, F.lit(1), k))))))
    return let(let(F.struct(doc.alias("x"), item.alias("y")), ways), most)


def best_window(doc: Column, item: Column, at: Column, start: Column, span: Column) -> Column:
    """Struct (matched, minus) of the best window around a hit that counts, minus being the negative number of words compared; else null.

    All words of an item with fewer than MATCHED must agree.
    """
    back = lambda text, to: F.reverse(F.slice(text, F.greatest(F.lit(0), to - FLANK) + 1, F.least(F.lit(FLANK), to)))
    ahead = lambda text, to: F.slice(text, to + span + 1, F.lit(FLANK))
    hit = _sum(_same(F.slice(doc, at + 1, span), F.slice(item, start + 1, span)))
    sides = F.struct(_outward(back(doc, at), back(item, start)).alias("l"), _outward(ahead(doc, at), ahead(item, start)).alias("r"), hit.alias("h"))
    least = F.least(F.lit(MATCHED), F.size(item))

    def pick(v: Column) -> Column:
        def pair(a: Column, i: Column, b: Column, k: Column) -> Column:
            m, n = v["h"] + a + b, span + i + k
            return F.when((m >= least) & (m >= SHARE * n), F.struct(m.alias("matched"), (-n).alias("minus")))

        return F.array_max(F.transform(v["l"], lambda a, i: F.array_max(F.transform(v["r"], lambda b, k: pair(a, i, b, k)))))

    return let(sides, pick)


def verified(doc: Column, item: Column, at: Column, start: Column, span: Column) -> Column:
    """Struct (fixed, matched, minus) of a hit that counts, else null: by the window of fixed flanks, or failing that by the best one.

    fixed: 1 for the window of fixed flanks around a hit of the long masks.
    """
    def judged(o: Column) -> Column:
        good = (o["matched"] >= MATCHED) & (o["matched"] >= SHARE * o["compared"])
        fixed = F.when(span == SPAN, 1).otherwise(0)
        other = let(best_window(doc, item, at, start, span), lambda b: F.when(b.isNotNull(), F.struct(F.lit(0).alias("fixed"), b["matched"].alias("matched"), b["minus"].alias("minus"))))
        return F.when(good, F.struct(fixed.alias("fixed"), o["matched"].alias("matched"), (-o["compared"]).alias("minus"))).otherwise(other)

    return let(overlap(doc, item, at, start), judged)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, compared): the best overlap of each document and benchmark item that counts.

    docs: doc_id, text; benchmark: item_id, text. A passage counts with at least MATCHED agreeing words and that SHARE of the words compared,
    wherever in the item it comes from; where a window of fixed flanks counts, its figures are given. Of items with fewer words all
    must agree. Items and documents with fewer than SHORT_SPAN words, null or empty texts, and rows
    with null ids have no windows and never count. Repeated rows give one pair. Items with equal words are compared once and
    reported all. A benchmark of up to BROADCAST_WINDOWS windows is sent to the executors, for a larger one hashes are shuffled. A hit
    then goes on with the words around it only, never with a whole text, and hits that look alike count once.
    """
    items = benchmark.where("item_id is not null").select("item_id", tokens(F.col("text").cast("string")).alias("item")).where(F.size("item") >= SHORT_SPAN)
    items = keep(items.distinct(), "items")
    texts = items.groupBy("item").agg(F.min("item_id").alias("rep"))
    texts = keep(texts, "item-texts")
    seeds = _windows(texts.withColumnRenamed("item", "words"), "rep").withColumnRenamed("pos", "start")
    # A hash once, with all places it has in the benchmark: a common passage multiplies no rows before the hit is known.
    seeds = keep(seeds.groupBy("hash").agg(F.collect_list(F.struct("rep", "start", "span")).alias("places")), "seeds")

    docs = docs.where("doc_id is not null").select("doc_id", tokens(F.col("text").cast("string")).alias("words"))
    # A hit takes along the words that it can reach and no others. So hits in words that repeat are alike, and are compared once.
    near = [F.slice("words", F.greatest(F.lit(0), F.col("pos") - REACH) + 1, F.lit(REACH + SPAN + REACH)).alias("near"), F.least("pos", F.lit(REACH)).alias("at")]
    if small(seeds, BROADCAST_WINDOWS):
        hits = _windows(docs, "doc_id", "words").drop("span").join(F.broadcast(seeds), "hash").select("doc_id", *near, "places")
    else:
        hits = _windows(docs, "doc_id").drop("span").join(seeds, "hash").join(docs, "doc_id").select("doc_id", *near, "places")
    hits = hits.select("doc_id", "near", "at", F.explode("places").alias("p")).select("doc_id", "near", "at", "p.rep", "p.start", "p.span").distinct()
    found = verified(F.col("near"), F.col("item"), F.col("at"), F.col("start"), F.col("span"))
    hits = hits.join(sized(texts), "rep").select("doc_id", "rep", found.alias("o"))
    # One number that orders like the struct, so that maxima are taken by hash; compared once, as a filter before would do it again.
    best = hits.groupBy("doc_id", "rep").agg(F.max(F.col("o.fixed") * 1_000_000 + F.col("o.matched") * 1000 + 999 + F.col("o.minus")).alias("b")).where("b is not null")
    best = best.withColumn("matched", F.call_function("div", F.col("b") % 1_000_000, F.lit(1000))).withColumn("compared", 999 - F.col("b") % 1000)
    names = items.join(texts, "item").select("rep", "item_id")
    return best.join(names, "rep").select("doc_id", "item_id", F.col("matched").cast("long"), F.col("compared").cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that overlap the benchmark; rows with a null id stay."""
    leaked = keep(contaminated(docs, benchmark).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def op3_spaced_seed_decontamination(spark, sf_dir):
    """The pairs of a document and a benchmark item that it contains."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_spaced_seed_decontamination": op3_spaced_seed_decontamination}

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _sql_seeds(name: str, key: str, source: str) -> str:
    one = lambda k, m: f"SELECT {key}, i AS pos, {k} AS mask, array_to_string([{', '.join(f'w[i + {j + 1}]' for j, c in enumerate(m) if c == '1')}], ' ') AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM {source} WHERE len(w) >= {SPAN})"
    return f"{name} AS ({' UNION ALL '.join(one(k, m) for k, m in enumerate(MASKS))})"


#: Pairs of the table {docs} and the benchmark.
LEAKS_SQL = f"""
ld AS (SELECT DISTINCT doc_id, {_TOKENS} AS w FROM {{docs}} WHERE doc_id IS NOT NULL),
lb AS (SELECT DISTINCT item_id, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
{_sql_seeds("lds", "doc_id", "ld")}, {_sql_seeds("lbs", "item_id", "lb")},
lh AS (SELECT DISTINCT doc_id, item_id, lds.pos AS p, lbs.pos AS q FROM lds JOIN lbs USING (mask, seed)),
lo AS (SELECT doc_id, item_id, least({FLANK}, p, q) AS back, p, q, least(least({FLANK}, p, q) + {SPAN + FLANK}, len(ld.w) - p + least({FLANK}, p, q),
  len(lb.w) - q + least({FLANK}, p, q)) AS compared, ld.w AS x, lb.w AS y FROM lh JOIN ld USING (doc_id) JOIN lb USING (item_id)),
lm AS (SELECT doc_id, item_id, compared, len(list_filter(range(0, compared), lambda i: x[p - back + i + 1] = y[q - back + i + 1])) AS matched FROM lo),
leaks AS (SELECT doc_id, item_id, max(matched)::BIGINT AS matched, min(compared) FILTER (matched = top)::BIGINT AS compared FROM (
  SELECT *, max(matched) OVER (PARTITION BY doc_id, item_id) AS top FROM lm WHERE matched >= {MATCHED} AND matched >= {SHARE} * compared) GROUP BY 1, 2)
"""

ORACLE_SQL = {"op3_spaced_seed_decontamination": "WITH " + LEAKS_SQL.replace("{docs}", "documents") + "SELECT * FROM leaks"}
