"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r = min(cap, q * exp(lambda of its source)): the distribution nearest to the base rates q, in relative
entropy weighted by size, whose words meet each source's target while no rate exceeds the cap. The lambdas solve the convex dual.
Its gradient, the words taken less the target, needs sums over cells (source, base rate) only, which all documents are counted
into first; Newton's iterations then run for all sources at once, each on its cells. The tilted rates are rounded into copies: the
integer part for all, and one more for the documents with the least u / fraction (u: a hash of the id in 0 .. 1), so that each
document gets its extra copy with a chance in proportion to its fraction, until the source's words are spent.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, keep, let, sized, table

#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most copies of a document.
SHARE, CAP = 1.5, 2
#: Texts of this many words have half of the base rate of long ones.
HALF = 20
#: Base rates are rounded on a grid of this many steps per factor e, from e**-LEVELS to e**LEVELS; a source has no more cells than that.
GRID, LEVELS = 20, 15
#: Most Newton steps, and the relative gap to the target at which they end; a larger one at the end raises.
NEWTON_STEPS, TOLERANCE = 200, 1e-9
#: Rates are whole billionths; a hash of the id has U bits.
UNIT, U_BITS = 1_000_000_000, 52
#: Ranges of u / fraction, and ranges within one of these; only one of the latter is put in order.
RANGES = 4096
#: Documents that may fill what a source's last one leaves.
FILLS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered(sources: DataFrame, col: str = "source") -> DataFrame:
    """Adds i: the place of each row (a row per source) in code point order from 0, null last. Ranges of sources are ordered by themselves."""
    cut = keep(sources.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("_p", F.spark_partition_id()), "sources")
    start = cut.groupBy("_p").agg(F.count("*").alias("_n"))
    start = start.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_0"))  # a row per range
    here = Window.partitionBy("_p").orderBy(F.col(col).asc_nulls_last())
    return cut.join(F.broadcast(start), "_p").withColumn("i", F.col("_0") + F.row_number().over(here) - 1).drop("_p", "_0")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources: source, source_size (a row per source). Adds target.

    The sources in code point order, null last, have the weights repeating. All words times share are dealt out by weight; what
    exceeds a source's cap * size is dealt out again among the others until none is above. A round is one sum over the sources.
    """
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    s = keep(ordered(sources).select("source", "source_size", nth.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most")), "weights")
    total = s.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    level, full = (share * (total["n"] or 0) / total["w"], -1) if total["w"] else (0.0, 0)
    while True:
        over = F.col("w") * level > F.col("most")
        got = s.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("most"))).alias("most"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if got["full"] == full or not got["w"]:
            break
        full, level = got["full"], (share * total["n"] - (got["most"] or 0.0)) / got["w"]
    return s.select("source", "source_size", F.round(F.least(F.col("w") * level, F.col("most")), 6).alias("target"))


def _solved(v: Column, cap: float) -> Column:
    """Struct (m, gap) for a struct (cells: array of (base, tokens), target): m = exp(lambda), and what the target is missed by.

    sum(tokens * min(base * m, cap)) is concave and piecewise linear in m. Newton's steps start below the solution, where no cell
    is capped, go up monotonically and end on its piece.
    """
    total = lambda m, of: F.aggregate(v["cells"], F.lit(0.0), lambda a, c: a + of(c, m))
    taken = lambda m: total(m, lambda c, m: c["tokens"] * F.least(c["base"] * m, F.lit(float(cap))))
    slope = lambda m: total(m, lambda c, m: F.when(c["base"] * m < cap, c["tokens"] * c["base"]).otherwise(0.0))

    def step(s: Column, _: Column) -> Column:
        gap = v["target"] - s["taken"]
        moved = s["m"] + F.coalesce(F.try_divide(gap, slope(s["m"])), F.lit(0.0))
        return F.when(gap <= TOLERANCE * 1e-3 * v["target"], s).otherwise(let(moved, lambda m: F.struct(m.alias("m"), taken(m).alias("taken"))))

    first = F.coalesce(F.try_divide(v["target"], total(F.lit(1.0), lambda c, _: c["tokens"] * c["base"])), F.lit(0.0))
    start = let(first, lambda m: F.struct(m.alias("m"), taken(m).alias("taken")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step, lambda s: F.struct(s["m"].alias("m"), (v["target"] - s["taken"]).alias("gap")))


def balanced_rates(cells: DataFrame, cap: float = CAP) -> DataFrame:
    """cells: source, base (positive), tokens, target (the source's). Adds rate = min(cap, base * exp(lambda)).

    Per source sum(tokens * rate) is the target, within TOLERANCE of it; a target that no rates can meet, above cap * tokens or
    without any tokens, raises. A target of zero or null has rates of zero. A source's cells meet in one row: a caller bounds their number.
    """
    per = cells.groupBy("source").agg(F.max(F.coalesce(F.col("target").cast("double"), F.lit(0.0))).alias("target"), F.collect_list(F.struct(F.col("base").cast("double").alias("base"), F.col("tokens").cast("double").alias("tokens"))).alias("cells"))
    per = per.withColumn("s", _solved(F.struct("cells", "target"), cap))
    unmet = F.raise_error(F.format_string("no rates meet the target %s of source %s", "target", "source")).cast("double")
    m = F.when(F.abs("s.gap") <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)), F.col("s.m")).otherwise(unmet)
    out = per.select("source", "target", m.alias("m"), F.explode("cells").alias("c"))
    return out.select("source", "c.base", "c.tokens", "target", F.least(F.col("c.base") * F.col("m"), F.lit(float(cap))).alias("rate"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, base: Column | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken.

    size counts words (null text: 0), taken is copies * size and at most cap * size; cap is a whole number. base: a positive base rate
    from columns of docs, by default size / (size + HALF), so that snippets are taken less often than long texts; it is rounded on
    a grid of LEVELS. The copies hang on the id's hash, so reruns agree; rows with equal ids and sizes are taken together or not at
    all. A source's taken words end below its target by less than its smallest documents where FILLS of them fit. A null id
    hashes like an empty one; a null source is a source of its own, the last. Empty tables give no rows.
    """
    if cap != int(cap) or cap < 1:
        raise ValueError("cap counts whole copies")
    size = F.col("size").cast("double")
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), (base if base is not None else F.lit(None)).cast("double").alias("given"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    level = F.round(GRID * F.log(F.coalesce(F.when(F.col("given") > 0, F.col("given")), F.greatest(size, F.lit(1.0)) / (size + HALF)))).cast("int")
    level = F.least(F.greatest(level, F.lit(-GRID * LEVELS)), F.lit(GRID * LEVELS))
    slim = keep(slim.select("doc_id", "source", "size", level.alias("level"), F.conv(F.substring("h", 1, U_BITS // 4), 16, 10).cast("long").alias("u")), "sizes")
    cells = keep(slim.groupBy("source", "level").agg(F.sum("size").alias("tokens")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, share, cap)
    of = cells.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", F.exp(F.col("level") / GRID).alias("base"), "tokens", "source_size", "target")
    rates = balanced_rates(of, cap).select("source", F.round(GRID * F.log("base")).cast("int").alias("level"), "tokens", "target", F.round(F.col("rate") * UNIT).cast("long").alias("rate"))
    rates = rates.withColumns({"copies": F.call_function("div", F.col("rate"), F.lit(UNIT)), "part": F.col("rate") % UNIT})
    own = Window.partitionBy("source")
    rates = rates.withColumns({"source_size": F.sum("tokens").over(own), "budget": F.greatest(F.floor(F.col("target") + 1e-6) - F.sum(F.col("copies") * F.col("tokens")).over(own), F.lit(0))})
    rates = sized(keep(rates.select("source", "level", "source_size", "target", "copies", "part", "budget"), "rates")).alias("r")
    same = lambda a, b, *cs: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cs]
    docs = slim.alias("d").join(rates, [*same("d", "r", "source"), F.col("d.level") == F.col("r.level")], "left")
    docs = docs.select("doc_id", "d.source", "size", "u", F.col("source_size"), "target", "copies", "part", "budget", F.when(F.col("part") > 0, F.col("u").cast("double") / F.col("part")).alias("p"))
    # p / (1 + p), from 0 to 1 and in the same order as p.
    place = let(F.col("p") / float((1 << U_BITS) / UNIT), lambda x: x / (1 + x) * RANGES)
    docs = docs.withColumn("place", place).withColumns({"range": F.floor("place").cast("int"), "fine": F.floor((F.col("place") - F.floor("place")) * RANGES).cast("int")})
    docs = keep(docs.drop("place"), "rated")

    # The range in which the extra copies end, in it the narrow one, and the words that this may still give. At most RANGES rows a source.
    def edge(sums: DataFrame, at: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return sums.withColumn("upto", upto).where("upto > budget and upto - n <= budget").select("source", F.col(at).alias(f"last_{at}"), (F.col("budget") - F.col("upto") + F.col("n")).alias("left"))

    wide = docs.where("range is not null").groupBy("source", "range").agg(F.sum("size").alias("n"), F.max("budget").alias("budget"))
    wide = sized(keep(edge(wide, "range"), "edges")).alias("e")
    narrow = docs.alias("d").join(wide, [*same("d", "e", "source"), F.col("range") == F.col("last_range")]).groupBy("d.source", "last_range", "fine").agg(F.sum("size").alias("n"), F.max("left").alias("budget"))
    narrow = keep(narrow, "narrow")
    last = edge(narrow, "fine").alias("e").join(narrow.groupBy("source").agg(F.max("last_range").alias("last_range")).alias("n"), same("e", "n", "source")).select("e.source", "last_range", "last_fine", "left")
    at = docs.alias("d").join(sized(keep(last, "last-ranges")).alias("e"), same("d", "e", "source"), "left")
    at = at.select("d.*", F.coalesce("last_range", F.lit(RANGES)).alias("last_range"), F.coalesce("last_fine", F.lit(RANGES)).alias("last_fine"), F.coalesce("left", F.lit(0)).alias("left"))
    here = F.coalesce((F.col("range") == F.col("last_range")) & (F.col("fine") == F.col("last_fine")), F.lit(False))
    before = F.coalesce((F.col("range") < F.col("last_range")) | ((F.col("range") == F.col("last_range")) & (F.col("fine") < F.col("last_fine"))), F.lit(False))
    within = Window.partitionBy("source").orderBy("p", "size")
    ends = at.where(here).withColumn("upto", F.sum("size").over(within)).withColumn("extra", F.col("upto") <= F.col("left"))
    rest = at.where(~here).withColumns({"upto": F.lit(0).cast("long"), "extra": before})
    dealt = keep(ends.unionByName(rest), "dealt")

    # What the last document leaves is filled with the largest ones that fit, of equal ones the next in order.
    left = dealt.where(here).groupBy("source").agg((F.max("left") - F.coalesce(F.max(F.when(F.col("extra"), F.col("upto"))), F.lit(0))).alias("gap"))
    left = sized(keep(left, "gaps"))
    fit = dealt.where("not extra and range is not null and size > 0").alias("d").join(left.alias("g"), [*same("d", "g", "source"), F.col("size") <= F.col("gap")])
    fit = keep(fit.groupBy("d.source", "size").agg(F.min(F.struct("p", "u")).alias("next"), F.max("gap").alias("gap")).select("source", "size", "next.u", "gap"), "fits")
    fill = None
    for _ in range(FILLS):
        best = fit.groupBy("source").agg(F.max(F.struct("size", "u")).alias("b"), F.max("gap").alias("gap")).select("source", "b.size", "b.u", (F.col("gap") - F.col("b.size")).alias("gap"))
        fill = best if fill is None else fill.unionByName(best)
        less = best.select("source", F.col("size").alias("was"), F.col("gap").alias("gap2")).alias("b")
        fit = fit.alias("f").join(less, [*same("f", "b", "source"), F.col("size") < F.col("was"), F.col("size") <= F.col("gap2")]).select("f.source", "size", "u", F.col("gap2").alias("gap"))
    chosen = sized(keep(fill.select("source", "size", "u"), "fills")).alias("c")
    hit = [*same("d", "c", "source"), F.col("d.size") == F.col("c.size"), F.col("d.u") == F.col("c.u")]
    # A document that several rows hold would be filled in more than once: it stays out.
    alone = dealt.alias("d").join(chosen, hit).groupBy("d.source", "d.size", "d.u").agg(F.count("*").alias("n")).where("n = 1").select("source", "size", "u", F.lit(True).alias("filled"))
    out = dealt.alias("d").join(sized(keep(alone, "filled")).alias("c"), hit, "left")
    copies = F.col("copies") + F.when(F.col("extra") | F.col("filled").isNotNull(), 1).otherwise(0)
    return out.select("doc_id", "d.size", "source_size", "target", (copies * F.col("d.size")).cast("long").alias("taken"))


def op2_entropy_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op2_entropy_mixing": op2_entropy_mixing}

#: The dual in closed form: with the cells of a source from the greatest base rate down, the first k are at the cap for the one k that
#: leaves the next one below it. Targets by the water level at which sources are full. MIX_SQL mixes the table {docs}.
MIX_SQL = rf"""
z AS (SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u,
  greatest(round({GRID} * ln(greatest(size, 1) / (size + {HALF}))), -{GRID * LEVELS})::INT AS level FROM (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size FROM {{docs}})),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM g),
v AS (SELECT *, most / w AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
  sum(most) OVER o AS most_here, sum(w) OVER o AS w_here FROM w WINDOW o AS (ORDER BY most / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, (total - (most_here - most)) / (w_all - (w_here - w)) AS level FROM v),
t AS (SELECT source, source_size, round(least(coalesce(w * max(CASE WHEN level <= full_at THEN level END) OVER (), most), most), 6) AS target FROM y),
ce AS (SELECT source, level, exp(level / {GRID}.0) AS base, sum(size)::DOUBLE AS tokens FROM z GROUP BY ALL),
cs AS (SELECT ce.*, source_size, target, coalesce(sum(tokens) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(tokens * base) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM ce JOIN t ON t.source IS NOT DISTINCT FROM ce.source WINDOW b AS (PARTITION BY ce.source ORDER BY base DESC)),
cm AS (SELECT *, CASE WHEN free > 0 THEN (target - 2 * capped) / free END AS m FROM cs),
cr AS (SELECT * EXCLUDE (m), round(least(base * coalesce(max(CASE WHEN base * m <= 2 * (1 + 1e-12) THEN m END) OVER (PARTITION BY source), 0), 2) * 1e9)::BIGINT AS rate FROM cm),
r AS (SELECT source, level, source_size, target, rate // 1000000000 AS copies, rate % 1000000000 AS part,
  greatest(floor(target + 1e-6) - sum((rate // 1000000000) * tokens) OVER (PARTITION BY source), 0)::BIGINT AS budget FROM cr),
d AS (SELECT doc_id, z.source, size, u, source_size, target, copies, part, budget, CASE WHEN part > 0 THEN u::DOUBLE / part END AS p
  FROM z JOIN r ON r.source IS NOT DISTINCT FROM z.source AND r.level = z.level),
x AS (SELECT *, row_number() OVER () AS n, CASE WHEN p IS NOT NULL THEN sum(size) OVER (PARTITION BY source, p IS NULL ORDER BY p, size) END AS upto FROM d),
e AS (SELECT *, coalesce(upto <= budget, false) AS extra FROM x),
q AS (SELECT source, max(budget) - coalesce(max(upto) FILTER (extra), 0) AS gap FROM e WHERE p IS NOT NULL GROUP BY 1),
f0 AS (SELECT e.source, size, arg_min(u, (p, u)) AS u, max(gap) AS gap FROM e JOIN q ON q.source IS NOT DISTINCT FROM e.source WHERE NOT extra AND p IS NOT NULL AND size > 0 AND size <= gap GROUP BY 1, 2),
b1 AS (SELECT source, max(size) AS size, arg_max(u, size) AS u, max(gap) - max(size) AS gap FROM f0 GROUP BY 1),
f1 AS (SELECT f.source, f.size, f.u, b.gap FROM f0 f JOIN b1 b ON b.source IS NOT DISTINCT FROM f.source WHERE f.size < b.size AND f.size <= b.gap),
b2 AS (SELECT source, max(size) AS size, arg_max(u, size) AS u, max(gap) - max(size) AS gap FROM f1 GROUP BY 1),
f2 AS (SELECT f.source, f.size, f.u, b.gap FROM f1 f JOIN b2 b ON b.source IS NOT DISTINCT FROM f.source WHERE f.size < b.size AND f.size <= b.gap),
b3 AS (SELECT source, max(size) AS size, arg_max(u, size) AS u, max(gap) - max(size) AS gap FROM f2 GROUP BY 1),
k AS (SELECT n, count(*) OVER (PARTITION BY e.source, e.size, e.u) AS c FROM e JOIN (FROM b1 UNION ALL FROM b2 UNION ALL FROM b3) b
  ON b.source IS NOT DISTINCT FROM e.source AND b.size = e.size AND b.u = e.u)
SELECT doc_id, size, source_size, target, ((copies + CASE WHEN extra OR k.n IS NOT NULL THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM e LEFT JOIN k ON k.n = e.n AND k.c = 1
"""

ORACLE_SQL = {"op2_entropy_mixing": "WITH " + MIX_SQL.format(docs="documents")}
