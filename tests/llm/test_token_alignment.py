"""Token alignment against byte sets: whole texts through both tokenizers, every pair of tokens by the bytes that both cover."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import token_alignment as T
from tidemark.llm.common import keep


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{T.FOLDER}/{T.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{T.FOLDER}/{T.PIECE_BPE}")


def by_hand(coders, text):
    """Ids of both sides with the sets of bytes that each token covers, or none."""
    if not text:
        return [], []
    coder_a, coder_b = coders
    values = T.byte_values()
    a = [(i, bytes(values[c] for c in coder_a.id_to_token(i))) for i in coder_a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in coder_b.encode(text):
        piece = coder_b.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if coder_b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (a, b)):
        return [], []
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def expected(coders, texts):
    links, rows = [], []
    for t in texts:
        a, b = by_hand(coders, t)
        links.append([(x, y) for x, lo, hi in a for y, low, high in b if max(lo, low) < min(hi, high)])
        ends = sorted({hi for _, _, hi in a} & {hi for _, _, hi in b})
        inside = lambda side, lo, hi: ",".join(str(i) for i, s, e in side if s >= lo and e <= hi)
        groups = ";".join(f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *ends], ends, strict=False))
        rows.append((len(a), len(b), len(ends), len(links[-1]), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    count = Counter(p for x in links for p in x)
    top = {b: max(n for (_, y), n in count.items() if y == b) for b in {b for _, b in count}}
    return [(*r[:4], sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), r[4]) for r, x in zip(rows, links, strict=True)]


ODD = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "a \n b", "a b 　 c", "it's  we'll", "▁", "x ▁ y", "naïve façade – “quoted”…", "日本語 のテキスト 🙂🙂 x",
    "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ ﬂ Å é", "\x00 \x01\x1f x\x1cy \x1c z", "1234567890 3.14 1,000,000", "\t\ttabs\tand \t spaces  \n\n\n end  ", "a" * 3000, " " * 500 + "x" + " " * 500, "\n" * 300, "-" * 700, "abc " * 400,
    "é" * 300, "​ ‍ x y  z\x85w",
]


def test_parts_equal_whole_texts(coders):
    r = random.Random(5)
    signs = ["a", "B", "é", " ", " ", " ", "\n", "\t", " ", " ", "'s", "the", "日", "🙂", "1", ".", ",", "-", "\x1c", "́", "\x00"]
    texts = ODD + ["".join(r.choice(signs) for _ in range(r.randrange(1, 60))) for _ in range(300)]
    parts = T._Parts(f"{T.FOLDER}/{T.BYTE_BPE}", f"{T.FOLDER}/{T.PIECE_BPE}")
    n_a, n_b, n_groups, n_links, groups, pairs, times, at = T._aligned(texts, parts)
    want = expected(coders, texts)
    got = [(int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), hashlib.sha256(groups[i].encode()).hexdigest() if groups[i] else "") for i in range(len(texts))]
    assert got == [(*w[:4], w[6]) for w in want]
    assert sum(w[0] > 0 for w in want) > 300 and want[ODD.index("▁")][0] == 0


def test_query_equals_brute_force(spark, coders, tmp_path):
    import duckdb

    texts = ODD + [x[0] for x in duckdb.connect().execute("select left(text, 600) from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 60").fetchall()]
    rows = [(None if i % 29 == 5 else i % 70, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as pairs", "1 as n_a", "2 as row")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = T.op11_token_alignment(spark, str(tmp_path)).collect()
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((str(r.doc_id), *(r[c] for c in columns)) for r in got) == sorted((str(i), *e) for (i, _), e in zip(rows, expected(coders, texts), strict=True))


def test_pairs_beyond_the_broadcast_limit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = keep(T.align_tokens(docs).withColumn("row", F.monotonically_increasing_id()), "t")
    few, many = ({r.row: (r.n_best, r.count_sum) for r in T.link_support(rows, limit).collect()} for limit in (50, 10**6))
    assert few == many and len(few) > 150


def test_empty_and_invalid(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xfe x")), (2, bytearray(b"fine"))], "doc_id long, text binary")
    got = {r.doc_id: r.n_a for r in T.align_tokens(df).collect()}
    assert got == {1: 0, 2: 1}
    assert T.align_tokens(df.where("false")).count() == 0


def test_long_text(spark):
    """A text of 2 MB without a single space, and one of 2 MB of words."""
    df = spark.createDataFrame([(1, "a\n" * 1_000_000), (2, "some words " * 180_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_a, r.n_groups) for r in T.align_tokens(df).select("doc_id", "n_a", "n_groups").collect()}
    assert got[1][0] >= 2_000_000 and got[2][1] >= 360_000
