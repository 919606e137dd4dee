"""Alignment of two tokenizers' tokens over the same texts.

Every text, with a space before it, is cut by both tokenizers into tokens that cover the same bytes. For each token's start an as-of merge
within the document finds the other side's token that covers it. An overlap begins where one of its two tokens begins, so both directions together
give all overlaps, the links. Byte offsets at which tokens of both sides end cut the sequences into groups.

How often a pair of ids is linked is counted over the whole corpus. Pairs travel once per document and with their number of links. A table of counts that
is small by count is sent to the executors; otherwise only the pairs that are held by so many documents that few can be (a bound, not a choice) are sent, and all
others, none of them frequent, meet their counts in a shuffle.

Defined results: a text that is null, empty, no valid UTF-8 or whose tokens do not spell it (as where it holds the piece tokenizer's mark for a space) has no
tokens. Rows that repeat an id are documents of their own, a null id stays null. Columns other than the id and the text are not looked at.
An empty table gives an empty result. A long text is cut where both tokenizers must cut, at single spaces between other signs, and encoded by its parts, so
that its memory is a multiple of its own length.
"""

import os
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, keep, small, table

#: Folder of the vocabulary files, to be found on every machine.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is one number, a * 2**ID_BITS + b.
ID_BITS = 20
#: Characters of text that are aligned at once (a longer text is taken whole), and tokens of known parts that a worker keeps.
CHUNK_CHARS, KEPT_TOKENS = 500_000, 2_000_000

#: Both sides begin a token at a single space between two other signs.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE_MARK = "▁"


def byte_values() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Bytes:
    """Byte-level BPE: ids of a text, bytes of an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of a pool would take others
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        values, vocabulary = byte_values(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in values for c in token):
                self.bytes[i] = bytes(values[c] for c in token)

    def encode(self, parts: list[str]) -> list[list[int]]:
        # So many at once, as an encoding holds much more than its ids.
        return [e.ids for at in range(0, len(parts), 1000) for e in self.tokenizer.encode_batch([" " + p for p in parts[at : at + 1000]], add_special_tokens=False)]


class _Pieces:
    """Pieces with byte fallback; the tokenizer adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", p) for p in pieces):
            raise ValueError(f"{path} has pieces that reach over a space, so texts cannot be cut there")
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1)


def _side(path: str):
    return _Pieces(path) if path.endswith(".model") else _Bytes(path)


class _Parts:
    """The parts of texts seen so far: their tokens on both sides one after another, and whether these spell the part."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np

        self.sides = [_side(path_a), _side(path_b)]
        if max(len(s.bytes) for s in self.sides) > 1 << ID_BITS:
            raise ValueError(f"ids beyond {1 << ID_BITS}")
        self.sizes = [np.array([len(b) for b in s.bytes], "int64") for s in self.sides]
        # The signs after an id: between ids of a group, after the last of the first side, after the last of the second.
        self.told = [f"{i}{end}" for ends, s in zip((",|", ",;"), self.sides, strict=True) for i in range(len(s.bytes)) for end in ends]
        self.told_size = np.array([len(t) for t in self.told], "int64")
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, "int64"), np.zeros(0, "int64")]
        self.at = [np.zeros(1, "int64"), np.zeros(1, "int64")]
        self.fine = np.zeros(0, bool)

    def learn(self, parts: list[str]) -> None:
        import numpy as np

        new = list(set(parts).difference(self.known))
        if not new:
            return
        want = [b" " + p.encode() for p in new]
        length = np.fromiter(map(len, want), "int64")
        fine = np.ones(len(new), bool)
        for k, side in enumerate(self.sides):
            ids = side.encode(new)
            flat = np.fromiter(chain.from_iterable(ids), "int64")
            ends = np.cumsum(np.fromiter(map(len, ids), "int64"))
            size = np.diff(np.concatenate([[0], np.cumsum(self.sizes[k][flat])])[ends], prepend=0)
            # All at once first; one by one only where some part is not spelled.
            if (size != length).any() or b"".join(map(side.bytes.__getitem__, flat.tolist())) != b"".join(want):
                fine &= np.array([b"".join([side.bytes[i] for i in x]) == w for x, w in zip(ids, want, strict=True)])
            self.at[k] = np.concatenate([self.at[k], len(self.ids[k]) + ends])
            self.ids[k] = np.concatenate([self.ids[k], flat])
        self.fine = np.concatenate([self.fine, fine])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def tokens(self, k: int, parts, docs):
        """Ids, ends and documents of the tokens of side k of these parts; ends count bytes over all documents."""
        import numpy as np

        low, n = self.at[k][parts], self.at[k][parts + 1] - self.at[k][parts]
        before = np.cumsum(n) - n
        ids = self.ids[k][np.repeat(low - before, n) + np.arange(n.sum())]
        return ids, np.cumsum(self.sizes[k][ids]), np.repeat(docs, n)


def _covering(start, doc, other_start, other_doc):
    """For each start the number of the other side's token that covers it: the last of the document that begins no later."""
    import numpy as np
    import pandas as pd

    left, right = pd.DataFrame({"at": start, "doc": doc}), pd.DataFrame({"at": other_start, "doc": other_doc, "hit": np.arange(len(other_start))})
    return pd.merge_asof(left, right, on="at", by="doc")["hit"].to_numpy("int64")


def _aligned(texts: list[str | None], parts: _Parts):
    """Lists by document: tokens of both sides, groups, links; the groups as text; distinct pairs, and the links of each."""
    import numpy as np

    n = len(texts)
    cut = [_CUT.split(t) if t else [] for t in texts]
    if len(parts.ids[0]) > KEPT_TOKENS:
        parts.clear()
    flat = list(chain.from_iterable(cut))
    parts.learn(flat)
    index = np.fromiter(map(parts.known.__getitem__, flat), "int64")
    docs = np.repeat(np.arange(n), [len(c) for c in cut])
    sound = np.bincount(docs[~parts.fine[index]], minlength=n) == 0
    index, docs = index[sound[docs]], docs[sound[docs]]
    (a, a_end, a_doc), (b, b_end, b_doc) = parts.tokens(0, index, docs), parts.tokens(1, index, docs)
    a_start, b_start = a_end - parts.sizes[0][a], b_end - parts.sizes[1][b]

    # Links: both directions, without those of the second that begin together and so were found by the first.
    hit_b, hit_a = _covering(a_start, a_doc, b_start, b_doc), _covering(b_start, b_doc, a_start, a_doc)
    own = a_start[hit_a] != b_start
    link_a, link_b = np.concatenate([np.arange(len(a)), hit_a[own]]), np.concatenate([hit_b, np.nonzero(own)[0]])
    link_doc = a_doc[link_a]
    # Documents of a chunk are few, but a text of many short ones may have more than fit above the ids.
    order = np.lexsort((pair := (a[link_a] << ID_BITS) | b[link_b], link_doc))
    pair, pair_doc = pair[order], link_doc[order]
    first = np.nonzero(np.diff(pair, prepend=-1) | np.diff(pair_doc, prepend=-1))[0]
    times = np.diff(first, append=len(pair))

    # Groups end where both sides end.
    a_last = np.isin(a_end, b_end, assume_unique=True)
    b_last = np.isin(b_end, a_end, assume_unique=True)
    a_to, b_to = np.nonzero(a_last)[0] + 1, np.nonzero(b_last)[0] + 1
    told = np.empty(len(a) + len(b), "int64")
    told[np.arange(len(a)) + np.concatenate([[0], b_to])[np.cumsum(a_last) - a_last]] = 2 * a + a_last
    told[np.arange(len(b)) + np.append(a_to, 0)[np.cumsum(b_last) - b_last]] = 2 * (len(parts.sizes[0]) + b) + b_last
    whole = "".join(map(parts.told.__getitem__, told.tolist()))
    count = lambda d: np.bincount(d, minlength=n)
    n_a, n_b = count(a_doc), count(b_doc)
    ends = np.concatenate([[0], np.cumsum(parts.told_size[told])])[np.cumsum(n_a + n_b)]
    groups = [whole[lo : hi - 1] if hi > lo else "" for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
    return n_a, n_b, count(a_doc[a_last]), count(link_doc), groups, pair[first], times, np.concatenate([[0], np.cumsum(count(pair_doc[first]))])


_LOADED: dict = {}


def _text(value: bytes | None) -> str | None:
    try:
        return value and value.decode()
    except UnicodeDecodeError:
        return None


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, first: str = BYTE_BPE, second: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links; groups (text a1,a2|b1;a3|b2,b3 with ids in order); pairs (array of a * 2**20 + b, each pair of ids linked in
    the document once, rising) and times (array: links of each).

    first is a byte-level BPE (json) or a piece model (.model), and so is second.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        paths = (f"{folder}/{first}", f"{folder}/{second}")
        if paths not in _LOADED:
            _LOADED[paths] = _Parts(*paths)
        parts = _LOADED[paths]

        def out(ids, texts):
            *counts, groups, pairs, times, at = _aligned(texts, parts)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(np.asarray(c), pa.int64()) for c in counts], pa.array(groups, pa.string()), *lists], names)

        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        for batch in batches:
            ids, texts, chars = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(_text(t.as_py()))
                chars += len(texts[-1] or "")
                if chars >= CHUNK_CHARS:
                    yield out(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield out(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, links (corpus-wide), held (rows that hold it), best (no other first id has more links with the same second id)."""
    counts = keep(pairs.groupBy("pair").agg(F.sum("times").alias("links"), F.count("*").alias("held")), "pair-counts")
    second = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    top = counts.groupBy(second.alias("second")).agg(F.max("links").alias("most"))
    return counts.join(top, second == F.col("second")).select("pair", "links", "held", (F.col("links") == F.col("most")).alias("best"))


def link_support(aligned: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """row, n_best, count_sum for the rows of aligned that have links: links whose pair is the best of its second id, and the sum of the links'
    corpus-wide counts. aligned has row (unique), pairs and times and is read several times."""
    pairs = aligned.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = keep(pair_counts(pairs), "pairs")
    if small(counts, limit):
        parts = [pairs.join(F.broadcast(counts), "pair")]
    else:
        # A pair held by over a limit-th of all rows of pairs: there are fewer than limit of them, so their broadcast is bounded by it.
        rows = counts.agg(F.sum("held")).first()[0]
        often = counts.where(F.col("held") * limit > rows)
        rest = pairs.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        parts = [pairs.join(F.broadcast(often), "pair"), rest.join(counts.hint("merge"), "pair")]
    sums = [p.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")) for p in parts]
    if len(sums) == 1:
        return sums[0]
    return sums[0].unionByName(sums[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op11_token_alignment(spark, sf_dir):
    got = align_tokens(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    rows = keep(got.select(F.monotonically_increasing_id().alias("row"), *columns, digest, "pairs", "times"), "aligned", compression="zstd")
    sums = link_support(rows)
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select(*columns, none("n_best"), none("count_sum"), "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}

#: SQL has no tokenizers; tests hold the query against a brute force.
ORACLE_SQL: dict[str, str] = {}
