r"""Phrases whose words keep together, mined by dynamic itemset counting.

The texts are dealt to shards, which are scanned in a cycle. Words are counted from the start. A longer phrase is activated at the step after which both its
subphrases, without its last and without its first word, have been seen often enough; from there on it is counted through one full cycle, so
its count is exact though lengths are counted side by side. The start of a longer phrase is the latest of its two subphrases' steps and starts.

The steps are remembered in a table of fixed size (SLOTS entries a length, by a hash of the phrase): a slot has the first step after which any of its
phrases was frequent. Phrases that share a slot with a frequent one start some longer phrases too many and none too few, and as a slot never changes
its step, these too are counted through exactly one cycle; their own counts show that they are rare. So every task knows what to count and no phrase has to be joined.
Texts are cut into words once: what is scanned are lots of texts of one language, as the lot's words and their numbers in order.
A scan's counts are merged with those of phrases in the midst of their cycle; a phrase leaves at the end of its cycle, with its count or, if rare, without trace.

A text is in lower case (A-Z only) and cut at [.,;:!?\x0A-\x0D] into pieces and at [\x20\x09] into words; phrases lie within pieces. All counts are by language. A
phrase's score is that of its worst cut in two: floor(2000000 * f / (f(first part) + f(rest))), in decimals of 38 digits. A phrase that lies in a longer one with
four fifths of its count or more is left out.

Defined results: a null text is empty, a null language is und; ids are not looked at, so rows that repeat an id or have none count like all others. Bytes that are
no UTF-8 become U+FFFD. An empty table gives an empty result. A long text is cut at pieces' ends, so no text needs more memory than some times its own length.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep, sized, table

#: Words of a phrase at most, its least count, the share of its count (in hundredths) from which a longer phrase replaces it.
LONGEST, LEAST, COVER = 4, 30, 80
#: Shards of a cycle; entries of a length's table of steps; bytes of text above which a text is cut; bytes of a lot of texts; words of a language that are counted at once.
SHARDS, SLOTS, CHUNK, LOT, COUNTED = 2, 1 << 22, 6_000_000, 2_000_000, 1_000_000
#: The step of what is not frequent; slots whose bits make a row on their way to the driver.
_NEVER, _BITS = 255, 1 << 15

# Signs that end a piece, and those that part words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: No byte of UTF-8: stands for the end of a piece.
_MARK = b"\xff"
_LOWER = bytes(ord(_MARK) if b in _ENDS else ord(" ") if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _numbered(texts: list[bytes]) -> tuple[bytes, bytes, int]:
    """A lot: its words, parted by blanks, the number of the word at each place, compressed, -1 where a piece ends, and how many places there are."""
    import numpy as np
    import pyarrow as pa

    numbers = _Numbers({_MARK: -1})
    numbers.next = 0
    words = _MARK.join(texts).translate(_LOWER).replace(_MARK, b" \xff ").split(b" ")
    gram = np.fromiter(map(numbers.__getitem__, filter(None, words)), "int32")
    return b" ".join(list(numbers)[1:]), pa.compress(gram.tobytes(), "zstd", asbytes=True), len(gram)


def _merged(lots: list[tuple[bytes, bytes, int]]):
    """The words of lots and the number of the word at each place, as one lot."""
    import numpy as np
    import pyarrow as pa

    numbers = _Numbers()
    numbers.next = 0
    grams = []
    for words, gram, places in lots:
        # The last entry is that of -1.
        own = np.fromiter(map(numbers.__getitem__, words.split(b" ") if words else []), "int64")
        grams += [np.append(own, -1)[np.frombuffer(pa.decompress(gram, 4 * places, "zstd"), "int32")], np.array([-1])]
    return list(numbers), np.concatenate(grams)


def _counted(lang: str, lots: list[tuple[bytes, bytes, int]], step: int, cycle: int, live: list[int], since):
    """Counts of one language's lots: (k, phrases, counts, slots, starts) for each length k in live.

    since[k] holds the first step of each slot for phrases of k words.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    text, gram = _merged(lots)  # the number of the phrase that starts here, or -1
    label = xxhash.xxh3_64_intdigest(lang.encode()) & 0xFFFFFFFF
    hashed = np.array([xxhash.xxh3_64_intdigest(w, seed=label) for w in text], "uint64")
    text = pa.array(text, pa.binary())
    rows = np.arange(len(text))[:, None]  # its words
    start = np.zeros(len(text), "int64")  # the step from which it is counted
    top = max(live, default=1)
    for k in range(1, top + 1):
        if k > 1:
            left, right = gram[:-1], gram[1:]
            at = np.nonzero((left >= 0) & (right >= 0))[0]
            at = at[(first[left[at]] <= step) & (first[right[at]] <= step)]
            code, pairs = pd.factorize(left[at] * len(rows) + right[at])
            gram = np.full(max(0, len(left)), -1)
            gram[at] = code
            one, two = np.divmod(pairs, max(1, len(rows)))
            # Not before both parts are told apart in every scan: a slot shared with an earlier phrase may be older than a part's own parts.
            start = np.maximum(np.maximum(first[one], first[two]), np.maximum(start[one], start[two]))
            rows = np.concatenate([rows[one], rows[two][:, -1:]], 1)
        mixed = np.full(len(rows), 0x9E3779B97F4A7C15, "uint64")
        for c in range(k):
            mixed = (mixed ^ hashed[rows[:, c]]) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
        slot = (mixed % np.uint64(len(since[1]))).astype("int64")
        if k in live:
            n = np.bincount(gram[gram >= 0], minlength=len(rows))
            here = np.nonzero((n > 0) & (step < start + cycle))[0]
            parts = [text.take(pa.array(rows[here, c])) for c in range(k)]
            yield k, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0], n[here], slot[here], start[here]
        if k < top:
            first = since[k][slot].astype("int64")


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    next: int

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.next
        self.next = n + 1
        return n


def _clean(text: bytes | None) -> bytes:
    return (text or b"") if _MARK not in (text or b"") else text.decode("utf-8", "replace").encode()


def _pieces(text: bytes):
    """The text, or parts of it that end where pieces end, of about CHUNK bytes."""
    import re

    at = 0
    while len(text) - at > 2 * CHUNK:
        end = re.compile(b"[.,;:!?\n\x0b\x0c\r]").search(text, at + CHUNK)
        if not end:
            break
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


def _lots(texts: DataFrame) -> DataFrame:
    """lang, shard, words, gram, places: texts of one language and shard in lots of about LOT bytes, as _numbered gives them."""

    def run(batches):
        import pyarrow as pa

        waiting: dict[tuple[str, int], list[bytes]] = {}
        size: dict[tuple[str, int], int] = {}

        def lot(key: tuple[str, int]):
            size.pop(key)
            words, gram, places = _numbered(waiting.pop(key))
            columns = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([words], pa.binary()), pa.array([gram], pa.binary()), pa.array([places], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "shard", "words", "gram", "places"])

        for batch in batches:
            for *key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                key = tuple(key)
                for piece in _pieces(_clean(text.as_py())):
                    waiting.setdefault(key, []).append(piece)
                    size[key] = size.get(key, 0) + len(piece) + 1
                    if size[key] > LOT:
                        yield lot(key)
                    elif sum(size.values()) > 2 * CHUNK:  # many languages
                        yield lot(max(size, key=size.get))
        for key in list(waiting):
            yield lot(key)

    return texts.select("lang", "shard", "text").mapInArrow(run, "lang string, shard int, words binary, gram binary, places long")


def _scan(lots: DataFrame, step: int, cycle: int, live: list[int], filled, slots: int) -> DataFrame:
    """k, lang, phrase, n, slot, start: what is counted at this step, by lots of a language. filled is a broadcast of the tables of steps by length, compressed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        since = {k: np.full(slots, _NEVER, "uint8") for k in range(1, max(live) + 1) if k not in filled.value}
        since |= {k: np.frombuffer(pa.decompress(steps, slots, "zstd"), "uint8") for k, steps in filled.value.items()}
        waiting: dict[str, list[tuple[bytes, bytes, int]]] = {}
        size: dict[str, int] = {}

        def counted(lang: str):
            size.pop(lang)
            for k, phrases, n, slot, start in _counted(lang, waiting.pop(lang), step, cycle, live, since):
                columns = [pa.array(np.full(len(n), k), pa.int32()), pa.array([lang] * len(n), pa.string()), phrases, pa.array(n, pa.int64()), pa.array(slot, pa.int32()), pa.array(start, pa.int32())]
                for at in range(0, len(n), 100_000):
                    yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], ["k", "lang", "phrase", "n", "slot", "start"])

        for batch in batches:
            for lang, words, gram, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append((words.as_py(), gram.as_py(), places))
                size[lang] = size.get(lang, 0) + places
                if size[lang] > COUNTED:
                    yield from counted(lang)
                elif sum(size.values()) > 2 * COUNTED:  # many languages
                    yield from counted(max(size, key=size.get))
        for lang in list(waiting):
            yield from counted(lang)

    got = lots.select("lang", "words", "gram", "places").mapInArrow(run, "k int, lang string, phrase binary, n long, slot int, start int")
    return got.withColumn("phrase", F.col("phrase").cast("string"))


def _part(first: str, words: Column) -> Column:
    """The first (words > 0) or last (words < 0) words of a phrase."""
    return F.call_function("substring_index", F.col(first), F.lit(" "), words)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Two tables: k, lang, phrase, n for every word or longer phrase with a count of least or more; lang, n for the words of each language."""
    spark = docs.sparkSession
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffles of a scan go when its result is written
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        return _cycles(spark, docs, text_col, lang_col, longest, least, shards, slots)
    finally:
        spark.conf.set(cleanup, before)


def _cycles(spark, docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int, shards: int, slots: int) -> tuple[DataFrame, DataFrame]:
    import numpy as np
    import pyarrow as pa

    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    lots = _lots(texts.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")))
    # Rows of megabytes: pages are written row by row, not by the hundred.
    lots = keep(lots, "lots", partitionBy="shard", compression="zstd", **{"parquet.page.size.row.check.min": 1})
    since = {k: np.full(slots, _NEVER, "uint8") for k in range(1, longest)}
    amid, ended, sizes = None, [], []
    step, until = 0, [0, shards] + [0] * (longest - 1)  # until[k]: phrases of k words may be counted before this step
    while step < max(until):
        live = [k for k in range(1, longest + 1) if step < until[k]]
        filled = {k: pa.compress(s.tobytes(), "zstd", asbytes=True) for k, s in since.items() if k < max(live)}
        sent = spark.sparkContext.broadcast(filled)
        counts = _scan(lots.where(F.col("shard") == step % shards), step, shards, live, sent, slots)
        total = (counts if amid is None else amid.unionByName(counts)).groupBy("k", "lang", "phrase", "slot", "start").agg(F.sum("n").alias("n"))
        over = F.col("start") + shards - 1 <= step
        # Rare words of a finished cycle are left with their numbers only, for the size of a language.
        state = keep(total.where((F.col("n") >= least) | ~over | (F.col("k") == 1)), f"phrases-{step}", compression="zstd")
        sent.destroy()
        amid = state.where(~over)
        ended.append(state.where(over & (F.col("n") >= least)))
        if step == shards - 1:
            sizes = state.where("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))
        # A bit for each slot, whatever the corpus: rows of slots would follow the frequent phrases.
        new = state.where((F.col("n") >= least) & (F.col("k") < longest)).groupBy("k", F.expr(f"slot div {_BITS}").alias("row"))
        for k, row, bits in new.agg(F.bitmap_construct_agg(F.col("slot").cast("long") % _BITS)).collect():
            at = row * _BITS + np.nonzero(np.unpackbits(np.frombuffer(bits, "uint8"), bitorder="little"))[0]
            at = at[since[k][at] == _NEVER]
            since[k][at] = step + 1
            if len(at):  # Longer phrases wait for all their parts.
                until[k + 1 :] = [step + 1 + shards] * (longest - k)
        step += 1
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.select("k", "lang", "phrase", "n"), sizes


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, **scan) -> DataFrame:
    """lang, phrase, k (its words), a (its count), l and r (those of its worst cut), n (words of the language), score: all candidates
    of two words or more that no longer one covers. scan: shards and slots."""
    counts, n = phrase_counts(docs, text_col, lang_col, longest, least, **scan)
    often = keep(counts.withColumnRenamed("n", "a"), "frequent")
    long_ = often.where("k > 1")
    cuts = long_.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"head": _part("phrase", F.col("cut")), "rest": _part("phrase", F.col("cut") - F.col("k"))})
    for name, count in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(often.select("lang", F.col("phrase").alias(name), F.col("a").alias(count)), ["lang", name])
    score = F.expr("(cast(a as decimal(29, 0)) * 2000000) div cast(l + r as decimal(20, 0))")
    worst = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    over = long_.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = worst.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a")))
    return left.join(sized(n), "lang").select("lang", "phrase", "k", "a", "w.l", "w.r", "n", "w.score")


def op13_collocations(spark, sf_dir):
    found = collocations(table(spark, sf_dir, "documents"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank.cast("long")).where("rank <= 2000").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op13_collocations": op13_collocations}

ORACLE_SQL = {
    "op13_collocations": r"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= 30),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cut AS (
  SELECT lang, phrase, k, a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a) // (x.a + y.a) AS score, j
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM worst WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = worst.lang AND len(c.phrase) > len(worst.phrase) AND contains(' ' || c.phrase || ' ', ' ' || worst.phrase || ' ') AND 100 * c.a >= 80 * worst.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
}
