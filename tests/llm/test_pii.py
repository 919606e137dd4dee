import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

KEY = "k1"


def mapped(spark, values, back=False, key=KEY):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    rows = df.select("i", pii.pseudonym(F.col("v"), key, back).alias("p")).select("i", "p.kind", "p.text").orderBy("i").collect()
    return [r.kind for r in rows], [r.text for r in rows]


VALUES = {
    "email": ["und.34@mail7.example.com", "averyveryverylongname1234567@x.org"],
    "secret": ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"],
    "ip": ["10.0.0.1", "255.255.255.255", "97.51.17.173"],
    "date": ["2024-02-29", "1999-12-31", "29.02.2000", "12/31/1999"],
    "ssn": ["123-45-6789", "899-99-9999", "667-01-0001", "665-01-0001"],
    "phone": ["+1 (017) 555-7713", "(030) 555-7713", "030-555-7713"],
    "card": ["4111 1111 1111 1111", "4111-1111-1111-1111"],
    "number": ["4111111111111111", "9807915762804490", "1234567890123456789", "4222222222222"],
}


def test_round_trip_keeps_kind_and_format(spark):
    values = [(k, v) for k, vs in VALUES.items() for v in vs]
    kinds, out = mapped(spark, [v for _, v in values])
    assert kinds == [k for k, _ in values]
    again, back = mapped(spark, out, back=True)
    assert back == [v.lower() if k == "email" else v for k, v in values] and again == kinds
    for (kind, a), b in zip(values, out):
        assert a != b
        if kind not in ("email", "ip", "secret"):
            assert re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b)
        assert kind == "ip" or len(a) == len(b)
    other = mapped(spark, [v for _, v in values], key="k2")[1]
    assert all(a != b for a, b in zip(out, other))


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_checksums_and_calendar_stay(spark):
    values = VALUES["number"] + VALUES["card"]
    _, out = mapped(spark, values)
    assert [luhn(a) for a in values] == [luhn(b) for b in out]
    days = [f"{y}-{m:02d}-{d:02d}" for y, m, d in ((2024, 2, 29), (1800, 1, 1), (2199, 12, 31), (2000, 6, 15))]
    _, out = mapped(spark, days)
    assert len({date.fromisoformat(x) for x in out}) == 4


def test_day_first_and_one_digit_dates_and_other_groupings(spark):
    values = [f"{d}/12/1999" for d in range(13, 32)] + ["31/1/2020", "13/9/1800", "29/02/2000", "1/5/2020", "1/31/2020", "12/5/2020", "1/05/2020", "31/12/2199", "5.1.2020", "31.1.2020", "5.12.2020", "9.9.2199"]
    values += ["3782 822463 10005", "3782-822463-10005", "555 123 4567"]
    kinds, out = mapped(spark, values)
    assert kinds == ["date"] * (len(values) - 3) + ["card"] * 2 + ["phone"]
    assert [re.sub(r"\d", "9", a) for a in values] == [re.sub(r"\d", "9", b) for b in out] and len(set(out)) == len(values)
    assert all(int(b.split("/")[0]) > 12 for a, b in zip(values, out) if re.match(r"(1[3-9]|2|3)\d?/", a))
    assert luhn(out[-3]) and luhn(out[-2])
    assert mapped(spark, out, back=True) == (kinds, values)
    assert mapped(spark, ["31/2/2020", "32/1/2020", "13/13/2020", "0/5/2020", "31/12/1799"])[0] == [None] * 5
    text = f"on {values[0]}, {values[22]} and {values[28]}: {values[-3]}, call {values[-1]}."
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first()
    assert got.n_pii == 5 and not any(v in got.text for v in (values[0], values[22], values[28], values[-3], values[-1]))


@pytest.mark.parametrize("months, least, most", [(9, 13, 31), (12, 13, 31), (9, 1, 9), (9, 1, 31), (12, 1, 9)])
def test_dates_are_permuted_among_their_like(spark, months, least, most):
    days = spark.range(146097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    days = days.where((F.month("d") <= months) & F.dayofmonth("d").between(least, most))
    out = days.select("d", pii._among(F.col("d"), months, least, most, KEY, False).alias("e")).select("d", "e", pii._among(F.col("e"), months, least, most, KEY, True).alias("f"))
    n, kinds, back, good = out.agg(F.count("*"), F.countDistinct("e"), F.count_if(F.col("d") == F.col("f")), F.count_if((F.month("e") <= months) & F.dayofmonth("e").between(least, most))).first()
    assert n == kinds == back == good


def test_invalid_values_stay(spark):
    values = ["256.1.1.1", "2023-02-29", "000-12-3456", "666-12-3456", "1700-01-01"]
    assert mapped(spark, values) == ([None] * 5, values)


def test_feistel_is_a_permutation(spark):
    out = [r.x for r in spark.range(35).select(pii.feistel(F.col("id"), 5, 7, F.lit("t"), KEY).alias("x")).collect()]
    assert sorted(out) == list(range(35)) and out != sorted(out)


def test_texts_nulls_and_links(spark):
    a = "mail und.34@mail7.example.com or +1 (017) 555-7713!\nIP 97.51.17.173, card 4111111111111111."
    rows = [(1, a, 9), (2, None, 9), (3, "", 9), (4, "see 97.51.17.173", 9), (4, "see 97.51.17.173", 9), (5, "plain 1234 text", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pii long")
    out = pii.pseudonymise(df, KEY)
    got = sorted((r.doc_id, r.text, r.n_pii, r.pii_kinds) for r in out.collect() if r.text is not None)
    by = {x[0]: x for x in got}
    assert by[1][2] == 4 and by[1][3] == ["email", "ip", "number", "phone"]
    assert by[3][1:] == ("", 0, []) and by[5][1:] == ("plain 1234 text", 0, [])
    new_ip = re.search(r"IP ([\d.]+),", by[1][1])[1]
    assert by[4][1] == f"see {new_ip}" and new_ip != "97.51.17.173"
    assert [r.n_pii for r in out.where("text is null").collect()] == [0]
    undone = pii.pseudonymise(out, KEY, back=True)
    assert {r.text for r in undone.collect()} == {r[1] for r in rows}
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def permuted(value, a, b, tweak, key=KEY):
    """Eight rounds by the definition: in odd ones the left part moves by a hash of the right one, in even ones the other way round."""
    left, right = divmod(value, b)
    for i in range(1, 9):
        moved = int(hashlib.sha256(f"{key}|{tweak}|{i}|{right if i % 2 else left}".encode()).hexdigest()[:15], 16)
        if i % 2:
            left = (left + moved) % a
        else:
            right = (right + moved) % b
    return left * b + right


def decimal(digits, kind):
    n, half = len(digits), len(digits) // 2
    return str(permuted(int(digits), 10**half, 10 ** (n - half), f"{kind}{n}")).zfill(n)


def luhn_sum(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d))


def refilled(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def by_definition(kind, v):
    """The pseudonym of a find, or None where validation fails; written from the formats alone."""
    digits = re.sub("[^0-9]", "", v)
    if kind in ("card", "number"):
        stay, body = (digits[0], digits[1:18]) if len(digits) == 19 else ("", digits[:-1])
        new = stay + decimal(body, "number")
        return refilled(v, new + str((luhn_sum(digits) - luhn_sum(new + "0")) % 10))
    if kind == "phone":
        code = (re.match(r"\+[0-9]{1,3}(?=[^0-9])", v) or [""])[0]
        rest = re.sub("[^0-9]", "", v[len(code) :])
        return code + refilled(v[len(code) :], decimal(rest, "phone")) if 7 <= len(rest) <= 15 else None
    if kind == "ip":
        parts = v.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
            return None
        new = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 16, 1 << 16, "ip")
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "ssn":
        area, group, serial = map(int, v.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        areas = [x for x in range(1, 900) if x != 666]
        new = permuted(areas.index(area) * 99 * 9999 + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{areas[new // (99 * 9999)]:03d}-{new // 9999 % 99 + 1:02d}-{new % 9999 + 1:04d}"
    if kind == "date_iso":
        try:
            gap = (date.fromisoformat(v) - date(1800, 1, 1)).days
        except ValueError:
            return None
        return (date(1800, 1, 1) + timedelta(permuted(gap, 189, 773, "date"))).isoformat() if 0 <= gap < 146097 else None
    radix, alphabet, name = (36, "0-9a-z", "email") if kind == "email" else (16, "0-9a-f", "secret")
    head, tail = (v[: v.index("@")], v[v.index("@") :]) if kind == "email" else (v, "")

    def piece(m):
        n, half, x = len(m[0]), len(m[0]) // 2, permuted(int(m[0], radix), radix ** (len(m[0]) // 2), radix ** (len(m[0]) - len(m[0]) // 2), f"{name}{len(m[0])}")
        out = ""
        for _ in range(n):
            out, x = "0123456789abcdefghijklmnopqrstuvwxyz"[x % radix] + out, x // radix
        return out

    new = re.sub(f"[{alphabet}]{{1,8}}", piece, head.lower())
    return (new.upper() if kind == "secret" and head == head.upper() != head.lower() else new) + tail


def rewritten(text):
    """The text with all finds replaced, how many are, and their kinds: Python's finder and the definition of each format."""
    kinds, n = {k: p.replace(r"[\p{L}\p{N}]", r"[^\W_]").replace(r"[\p{L}\p{N}._%+-]", r"[\w.%+-]").replace(r"\d", "[0-9]") for k, p in pii.PATTERNS.items()}, []

    def one(m):
        kind = next(k for k, p in kinds.items() if re.fullmatch(p, m[0]))
        new = by_definition(kind, m[0])
        if new is not None:
            n.append(kind.partition("_")[0])
        return m[0] if new is None else new

    return re.sub("|".join(kinds.values()), one, text), len(n), sorted(set(n))


def test_brute_force_on_texts(spark):
    """Finder, validation and permutations against Python, whole texts of the table and made ones with every kind, valid and not."""
    r = random.Random(1)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    make = [
        lambda: f"{r.choice(['und.', 'Aé', 'x'])}{num(r.randint(1, 12))}@mail{num(1)}.example.com", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([31, 32, 40, 64]))),
        lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(40)), lambda: ".".join(str(r.randint(0, 300)) for _ in range(4)), lambda: f"{r.randint(1790, 2210)}-{r.randint(1, 13):02d}-{r.randint(1, 31):02d}",
        lambda: f"{r.randint(0, 999):03d}-{r.randint(0, 99):02d}-{num(4)}", lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}",
        lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{num(4)}-{num(6)}-{num(5)}", lambda: num(r.randint(12, 20)), lambda: "word",
    ]
    texts = [" ".join(r.choice(make)() + r.choice(["", ",", ".", "!", "\n"]) for _ in range(r.randint(0, 30))) for _ in range(150)] + ["word " * 60_000 + "und.1@mail.example.com", num(16) + " " + ("9" * 70_000)]
    rows = list(enumerate(texts)) + [(10_000 + x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {x.doc_id: (x.text, x.n_pii, x.pii_kinds) for x in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), KEY).collect()}
    for i, text in rows:
        assert got[i] == rewritten(text), text[:300]
    assert {k for _, _, ks in got.values() for k in ks} == {"email", "secret", "ip", "date", "ssn", "phone", "card", "number"}


def test_values_without_end(spark):
    """A host of 20,000 labels, and runs of letters, digits and signs: patterns are loops and not recursions."""
    texts = ["x@b" + ".cd" * 20_000 + " end", "a" * 1_000_000, "1" * 1_000_000, "1." * 300_000, "+1 " * 200_000, "a@" * 300_000, "x@" + "-" * 500_000, "12-34-" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    assert len(got[0]) == len(texts[0]) and got[0] != texts[0] and all(got[i] == texts[i] for i in (1, 2, 6))
