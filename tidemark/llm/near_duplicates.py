"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature coordinate: the first scatters shingles over a universe of D positions, the second is a
fixed table of D values. Coordinate k of a document is the least table value at (position + k) modulo D, so one table, shifted
circularly, stands for K independent permutations. Bands of coordinates give buckets; candidates of a bucket are verified on
their full shingle sets, so no link is reported that the sets do not bear out.
"""

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, table

UNIVERSE = 1 << 20
#: Shingles whose table rows are held at once while a signature is made.
CHUNK = 4096
#: Words remembered per task with their hashes.
MEMO = 400_000
BANDS = 24
#: Bound on the chance that a pair exactly at the threshold shares no band.
MISS = 1e-5


def band_rows(percent: int) -> int:
    """Most rows a band can have while a pair at the threshold is missed with a chance of MISS at most."""
    s = percent / 100
    return max(r for r in range(1, 13) if r == 1 or (1 - s**r) ** BANDS <= MISS)


@lru_cache(maxsize=2)
def _circulant(k: int):
    import numpy as np

    table = np.random.default_rng(20240229).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: k - 1]]), k)


class _WordHash(dict):
    """Word to 64-bit hash; forgets nothing, but stops remembering at MEMO words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, size: int, memo: dict):
    """Sorted distinct 64-bit hashes of the shingles: size words each, or the whole sequence of a shorter text."""
    import numpy as np

    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    width = min(size, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(x)


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        windows, memo = _circulant(bands * rows), _WordHash()
        band_no = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            ids, sizes, prints, keys = batch.column(0), [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text, shingle, memo)
                sizes.append(len(s))
                if not len(s):
                    prints.append((0, 0))
                    keys.append([])
                    continue
                at = (_mixed(s + np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
                sig = np.min([windows[at[i : i + CHUNK]].min(axis=0) for i in range(0, len(at), CHUNK)], axis=0)
                key = band_no
                for column in sig.astype(np.uint64).reshape(bands, rows).T:
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
                keys.append(key.view(np.int64))
                prints.append(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64))
            two = np.array(prints, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return run


def _overlaps(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        memo, last = _WordHash(), (None, None)
        for batch in batches:
            found = []
            for a, b in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if last[0] != a:
                    last = (a, shingle_set(a, shingle, memo))
                s, t = last[1], shingle_set(b, shingle, memo)
                found.append((np.intersect1d(s, t, assume_unique=True).size, len(s), len(t)))
            counts = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[:, k]) for k in range(3)]], names=["a", "b", "both", "size_a", "size_b"])

    return run


def _tested(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """a, b, both, size_a, size_b: the sizes of the full shingle sets of each pair and of what they share."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_overlaps(shingle), "a long, b long, both long, size_a long, size_b long")


def _linked(tested: DataFrame, percent: int) -> DataFrame:
    return tested.where(f"both > 0 and 100 * both >= {percent} * (size_a + size_b - both)").select("a", "b")


def _sets(shingle: int):
    def run(batches):
        import pyarrow as pa

        memo = _WordHash()
        for batch in batches:
            sets = [shingle_set(t, shingle, memo).view("int64") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "s"])

    return run


def _shared_counts(texts: DataFrame, shingle: int) -> DataFrame:
    """rep, common: how many shingles of a text occur in another text of the table. No pair of it can share more."""
    each = texts.mapInArrow(_sets(shingle), "rep long, s array<long>").select("rep", F.explode("s").alias("g"))
    twice = each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    return each.join(twice.hint("merge"), "g", "left_semi").groupBy("rep").agg(F.count("*").alias("common"))


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp) for every id on an edge; comp is the least id reachable.

    Each round takes the least label of all neighbours and then the label of that label, so chains shorten by halves; the
    rounds end when no label has changed. Only the count of changes reaches the driver.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("comp")), name)
    while True:
        low = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("low"))
        hooked = labels.join(low, "id").select("id", "comp", F.least("comp", "low").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("comp").alias("far"))
        after = keep(hooked.join(jump, "to").select("id", F.col("comp").alias("was"), F.least("to", "far").alias("comp")), name)
        labels, changed = after.select("id", "comp"), after.where("comp <> was").limit(1).count()
        if not changed:
            return labels


def _open_pairs(shared: DataFrame, classes: DataFrame, comps: DataFrame, star: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components and may still reach the threshold.

    Three exact bounds leave out what cannot: the sets' sizes; the triangle inequality of the Jaccard distance with the bucket's
    leader, to which all distances are known; and the numbers of shingles inside and outside the leader that occur in any other
    text here, of which a pair shares at most the smaller ones. A pair is given once, in the first bucket that it shares.
    """
    comps = comps.withColumnRenamed("id", "rep")
    at = shared.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = at.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("bucket")
    at = keep(at.join(mixed, "bucket", "left_semi"), "mixed")
    reps = at.select(F.col("rep").alias("doc_id")).distinct()
    common = _shared_counts(texts.join(reps.hint("merge"), "doc_id", "left_semi"), shingle)
    far = star.select(F.col("a").alias("lead"), F.col("b").alias("rep"), (1 - F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("far"), "both").groupBy("lead", "rep").agg(F.min("far").alias("far"), F.max("both").alias("inner"))
    sets = classes.join(common, "rep").groupBy("rep").agg(F.max("n_shingles").alias("n"), F.max("common").alias("common"), F.first("bands").alias("bands"))
    # A text whose shared shingles are too few for any link leaves here; so do the leaders, tested with all of their bucket.
    sets = sets.where(f"100 * common >= {percent} * n")
    at = keep(at.where("rep <> lead").join(far, ["lead", "rep"]).join(sets, "rep").select("bucket", "rep", "comp", "far", "inner", "n", "common", "bands"), "open")
    x, y = at.alias("x"), at.alias("y")
    # What two texts share lies inside the leader, at most the smaller part there, or outside it, at most what others share.
    least = F.least("x.inner", "y.inner") + F.least(F.col("x.common") - F.col("x.inner"), F.col("y.common") - F.col("y.inner"))
    before = lambda s: F.slice(f"{s}.bands", F.lit(1), F.array_position(f"{s}.bands", F.col(f"{s}.bucket")).cast("int") - 1)
    fits = (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.comp") != F.col("y.comp"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (100 * least >= percent * (F.col("x.n") + F.col("y.n") - least))
        & (F.abs(F.col("x.far") - F.col("y.far")) <= 1 - percent / 100 + 1e-9)
        & ~F.arrays_overlap(before("x"), before("y"))
    )
    return x.join(y, fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts whose shingle sets are equal form a class, and only its least id goes on. In each bucket the members are first
    verified against the bucket's least id; buckets that still span several components then have every pair between
    different components verified, so every pair that shares a bucket is either verified or joined already. Nothing is capped.

    Null or blank texts have no shingles and are linked with nothing. A row with a null id is linked with nothing, has a null
    component and is kept. Rows that repeat an id count as one document. Other columns of docs are not read. An empty table
    gives an empty result.
    """
    rows = band_rows(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
    sigs = keep(docs.mapInArrow(_signatures(shingle, BANDS, rows), kinds), "signatures")
    named = sigs.where("doc_id is not null and n_shingles > 0")
    classes = keep(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")

    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    lead = buckets.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead")
    shared = keep(buckets.join(lead, "bucket"), "buckets")
    star = shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    ids = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = keep(docs.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")

    twice = named.join(classes.drop("bands"), ["f1", "f2", "n_shingles"]).select("doc_id", "rep")
    split = twice.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = twice.join(split, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))

    star = keep(_tested(star, texts, shingle), "stars")
    edges = keep(_linked(star, percent).union(same_id), "links")
    comps = connected(edges)
    more = keep(_linked(_tested(_open_pairs(shared, classes, comps, star, texts, shingle, percent), texts, shingle), percent), "more-links")
    if more.limit(1).count():
        comps = connected(edges.union(more))

    of_class = classes.select("f1", "f2", "n_shingles", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("f1", "f2", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    out = sigs.drop("bands").join(of_class, ["f1", "f2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_minhash_dedup": op6_minhash_dedup}

ORACLE_SQL = {
    "op6_minhash_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
""",
}
