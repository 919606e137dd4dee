"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with the counts of the bytes that followed. The code length of
a text under a tree, with the counts frozen, is the sum over its bytes of -log2 of their probability: at the longest context
seen, the byte's share of the count if it followed there; else the probability of an escape, and the context one byte shorter,
down to a uniform byte. Escapes are counted by method C (as many as there were different bytes), without exclusion. The language
with the shortest code wins. As the counts are frozen, the length of a byte depends on the last ORDER + 1 bytes only, so the lengths
of all strings that some tree has seen are tabulated once, for all languages side by side, and texts are scored by lookups.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, keep, sized, table

ORDER = 3
#: Most labelled texts per language that the trees are made from, about, drawn by a hash of the id; whole texts.
TEXTS_PER_LANGUAGE = 2500
#: Languages are scored in blocks whose trees have about so many counts in all, and so many languages; a block is one pass over the texts.
BLOCK_GRAMS, BLOCK_LANGUAGES = 6_000_000, 40
#: Bytes scored at once.
SLICE = 1 << 20


def normal(text: str) -> bytes:
    """Small letters, as UTF-8, between two blanks; the code is not to depend on capitals."""
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def _grams(order: int):
    """(lang, text) to counts of byte strings of order + 1 bytes, packed into a long, per batch and language."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(b" " * (order - 1) + normal(text))
            for lang, texts in by.items():
                for part in range(0, len(texts), 500):
                    # Texts are apart by enough blanks that no string spans two of them in a way that tells languages apart.
                    b = np.frombuffer(b"".join(texts[part : part + 500]), np.uint8).astype(np.int64)
                    if len(b) <= order:
                        continue
                    g = np.zeros(len(b) - order, np.int64)
                    for i in range(order + 1):
                        g = (g << 8) | b[i : len(b) - order + i]
                    value, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value)), pa.array(value), pa.array(n, pa.int64())], names=["lang", "g", "n"])

    return run


class Trees:
    """The frozen context trees of some languages as tables of code lengths, a column per language.

    seen[d]: sorted strings of d + 1 bytes, packed, that some language has seen, and the lengths of their last byte after the d bytes before
    it. escape[d]: sorted contexts of d bytes that some language has seen, and the lengths of an escape from them (0 for a language without
    the context). A string that no language has seen costs the escape of its context and what the shorter string costs.
    """

    def __init__(self, counts: dict, order: int = ORDER):
        """counts: language to (grams, counts), the grams packed as by _grams."""
        import numpy as np

        self.order, self.langs = order, sorted(counts)
        self.seen, self.escape = [], []
        below = None  # per language: probabilities of the strings of the level below
        for d in range(order + 1):
            mask = (1 << (8 * (d + 1))) - 1
            own = []
            for lang in self.langs:
                g, n = counts[lang]
                value, at = np.unique(g & mask, return_inverse=True)
                c = np.bincount(at, weights=n, minlength=len(value))
                ctx, first, kinds = np.unique(value >> 8, return_index=True, return_counts=True)
                own.append((value, c, ctx, np.add.reduceat(c, first) if len(c) else c, kinds))
            strings = np.unique(np.concatenate([o[0] for o in own]))
            contexts = np.unique(np.concatenate([o[2] for o in own]))
            p = np.empty((len(strings), len(own)))
            leave = np.ones((len(contexts), len(own)))
            shorter = self._row(self.seen[d - 1][0], strings & (mask >> 8)) if d else None
            for j, (value, c, ctx, total, kinds) in enumerate(own):
                leave[np.searchsorted(contexts, ctx), j] = kinds / (total + kinds)
                # What a string costs that the language has not seen: its context's escape, if it has that, and the shorter string.
                p[:, j] = leave[np.searchsorted(contexts, strings >> 8), j] * (below[shorter, j] if d else 1 / 256)
                at = np.searchsorted(ctx, value >> 8)
                p[np.searchsorted(strings, value), j] = c / (total[at] + kinds[at])
            self.seen.append((strings, -np.log2(p).astype(np.float32)))
            self.escape.append((contexts, -np.log2(leave).astype(np.float32)))
            below = p

    @staticmethod
    def _row(keys, x):
        """The row of each x, all of which are among the keys."""
        import numpy as np

        return np.searchsorted(keys, x)

    def lengths(self, data: bytes):
        """Bits of the whole text under each tree, and the number of bytes coded."""
        import numpy as np

        b, o, total = np.frombuffer(data, np.uint8), self.order, np.zeros(len(self.langs))
        for start in range(0, max(0, len(b) - o), SLICE):
            part = b[start : start + SLICE + o].astype(np.int64)
            n = len(part) - o
            x = np.zeros(n, np.int64)
            for i in range(o + 1):
                x = (x << 8) | part[i : n + i]
            for d in range(o, -1, -1):
                keys, rows = self.seen[d]
                x &= (1 << (8 * (d + 1))) - 1
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                found = keys[at] == x
                total += rows[at[found]].sum(0, dtype=np.float64)
                x = x[~found]
                if not len(x):
                    break
                keys, rows = self.escape[d]
                at = np.minimum(np.searchsorted(keys, x >> 8), len(keys) - 1)
                total += rows[at[keys[at] == x >> 8]].sum(0, dtype=np.float64)
            else:
                total += 8.0 * len(x)
        return total, max(0, len(b) - o)


_MADE: dict = {}


def _scored(trees_of, key):
    """id and text to id, lang, bits and odds: the language with the shortest code, its length, and the sum of 2**(bits - length) over
    the languages. Texts that are null or have no letter have nulls. Trees are made once per Python worker from the broadcast counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Trees(trees_of.value)
        trees = _MADE[key]
        for batch in batches:
            lang, bits, odds = [], [], []
            for text in batch.column(1).to_pylist():
                if not text or not any(map(str.isalpha, text)):
                    lang.append(None), bits.append(None), odds.append(None)
                    continue
                length, _ = trees.lengths(b" " * (trees.order - 1) + normal(text))
                i = int(np.argmin(length))
                lang.append(trees.langs[i]), bits.append(float(length[i])), odds.append(float(np.exp2(np.maximum(length[i] - length, -1000)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(bits, pa.float64()), pa.array(odds, pa.float64())], names=["id", "lang", "bits", "odds"])

    return run


def count_grams(labelled: DataFrame, limit: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """labelled: doc_id, lang, text. Counts of byte strings by language over about `limit` whole texts of each language at most."""
    n = sized(labelled.groupBy("lang").agg(F.count("*").alias("all")))
    drawn = labelled.join(n, "lang").where(F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1_000_000)) < F.lit(1_000_000) * F.least(F.lit(1.0), limit / F.col("all")))
    return drawn.select("lang", "text").mapInArrow(_grams(ORDER), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def blocks(sizes: list[tuple[str, int]]) -> list[list[str]]:
    """Languages with the numbers of their counts, in runs of about BLOCK_GRAMS counts and BLOCK_LANGUAGES languages at most."""
    out: list[list[str]] = []
    room = 0
    for lang, n in sorted(sizes):
        if not out or n > room or len(out[-1]) == BLOCK_LANGUAGES:
            out.append([])
            room = BLOCK_GRAMS
        out[-1].append(lang)
        room -= n
    return out


def identify(docs: DataFrame, folds: int = 3) -> DataFrame:
    """A row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Rows whose crc32(doc_id) modulo `folds` is 1 are held out; the trees are learned from the others with a language and a text. A
    null text, one without a letter, or any text if there is nothing to learn from is `und` with score 0. Ties go to the
    language first in the alphabet. The score is the winner's posterior among all languages, taken as equally likely before:
    2**-bits over the sum of that of all languages. Neither lang, source nor id of a row enters it. Any number of languages
    and all bytes are told apart; a block of languages is a pass over the texts, which are then written once.
    """
    import uuid

    import numpy as np

    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = crc_mod(F.col("doc_id"), folds) == 1
    grams = keep(count_grams(docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())), "grams")
    runs = blocks([(r["lang"], r["n"]) for r in grams.groupBy("lang").agg(F.count("*").alias("n")).collect()])

    def score(df: DataFrame, run: list[str], id_type: str) -> DataFrame:
        rows = grams.where(F.col("lang").isin(run)).toPandas()
        counts = {lang: (own["g"].to_numpy(np.int64), own["n"].to_numpy(np.int64)) for lang, own in rows.groupby("lang")}
        return df.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex), f"id {id_type}, lang string, bits double, odds double")

    def told(df: DataFrame, doc_id: Column) -> DataFrame:
        return df.select(doc_id.alias("doc_id"), (crc_mod(doc_id, folds) == 1).alias("held_out"), F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("odds"), F.lit(0.0)).alias("score"))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    if not runs:
        return told(docs.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("odds")), F.col("doc_id"))
    if len(runs) == 1:
        return told(score(docs.select("doc_id", "text"), runs[0], id_type), F.col("id"))
    docs = keep(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "language-texts")
    each = None
    for run in runs:
        part = keep(score(docs.select("row", "text"), run, "long"), "languages")
        each = part if each is None else each.unionByName(part)
    best = each.groupBy("id").agg(F.min_by("lang", F.struct("bits", "lang")).alias("lang"), F.min("bits").alias("least"), F.collect_list(F.struct("bits", "odds")).alias("all"))
    odds = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["odds"] * F.pow(F.lit(2.0), F.greatest(F.col("least") - x["bits"], F.lit(-1000.0))))
    best = best.select("id", "lang", F.when(F.col("lang").isNotNull(), odds).alias("odds"))
    return told(docs.drop("text").join(best, F.col("row") == F.col("id")).select("doc_id", "lang", "odds"), F.col("doc_id"))


def op10_ppm_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op10_ppm_language": op10_ppm_language}
ORACLE_SQL = {}
