"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers, dates, addresses of mail and network, and keys are found by pattern and validated (calendar, checksum, ranges). A value
that passes is mapped by a keyed permutation of all values of its format: mixed-radix Feistel rounds on a pair (left, right),
where left and right in turn are shifted by a keyed hash of the other. A permutation keeps different values apart and equal values
linked across documents, and whoever has the key can undo it; the format (separators, lengths, checksums, leap days) stays.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, table

ROUNDS = 8
#: For tests and the registered query only; a job passes its own secret.
DEMO_KEY = "tidemark-demo-key"

#: Kinds in the order in which they are tried at a place of the text. A mail name has 64 signs at most by its standard, which also keeps
#: the search linear in runs of letters without end. Possessive repeats are loops; others recurse, once for each label of a host.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"\b[0-9a-f]{32,64}\b|\b[0-9A-F]{32,64}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "date_iso": r"\b\d{4}-\d{2}-\d{2}\b",
    "date_eu": r"\b\d{1,2}\.\d{1,2}\.\d{4}\b",
    "date_us": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}\b|\b\d{3}[ .-]\d{3}[ .-]\d{4}\b",
    "card": r"\b\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{5})\b",
    "number": r"\b\d{13,19}\b",
}
#: As one expression; the card's back-reference counts from the expression's start, its group being the only one.
ANY = "|".join(PATTERNS.values())
#: Days that a date is permuted in: the 400 years from this one repeat the calendar exactly (146,097 = 189 * 773 days).
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def feistel(value: Column, a: int | Column, b: int | Column, tweak: Column, key: str, back: bool = False) -> Column:
    """A keyed permutation of 0 .. a*b-1 (a * b below 2**63), its inverse if back; tweak chooses among unrelated permutations."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    long = value.cast("long")

    def shift(i: Column, half: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        left, right, odd = s["l"], s["r"], i % 2 == 1
        sign = F.lit(-1 if back else 1).cast("long")
        new_left = F.when(odd, F.pmod(left + sign * F.pmod(shift(i, right), a), a)).otherwise(left)
        new_right = F.when(odd, right).otherwise(F.pmod(right + sign * F.pmod(shift(i, left), b), b))
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    rounds = range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)
    start = F.struct(F.call_function("div", long, b).alias("l"), (long % b).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, step, lambda s: s["l"] * b + s["r"])


def _pad(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _filled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of digits."""
    places = F.split(shape, "")
    before = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
    return F.array_join(F.transform(places, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, before(i), F.lit(1))).otherwise(c)), "")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(11)]), n + 1)


def _decimal(digits: Column, kind: str, key: str, back: bool) -> Column:
    """Permutes strings of up to 18 digits of one length among each other."""
    n = F.length(digits)
    half = F.call_function("div", n, F.lit(2)).cast("int")
    return _pad(feistel(digits, _power(half), _power(n - half), F.concat(F.lit(kind), n.cast("string")), key, back), n)


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and cast out by nines; a multiple of ten if the number checks."""
    chars = F.reverse(F.split(digits, ""))
    doubled = lambda d: F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
    value = F.transform(chars, lambda c, i: F.when(i % 2 == 1, doubled(F.try_to_number(c, F.lit("9")).cast("int"))).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    return F.aggregate(value, F.lit(0), lambda x, y: x + y)


def _number(text: Column, key: str, back: bool) -> Column:
    """A number of 13 to 19 digits, separators kept. One that passes the card checksum gives one that passes, any other one that fails.

    All digits but the last are permuted; the last keeps its distance from the checksum's, so both kinds map onto themselves.
    """
    def mapped(d: Column) -> Column:
        # The first digit of 19 stays, so that the rest fits 17 digits and a long.
        stay = F.when(F.length(d) == 19, F.substring(d, 1, 1)).otherwise("")
        body = F.when(F.length(d) == 19, F.substring(d, 2, 17)).otherwise(F.substring(d, F.lit(1), F.length(d) - 1))
        new = F.concat(stay, _decimal(body, "number", key, back))
        gap = luhn_sum(d)
        return F.concat(new, F.pmod(gap - luhn_sum(F.concat(new, F.lit("0"))), F.lit(10)).cast("string"))

    return _filled(text, let(_digits(text), mapped))


def _mixed(rank: Column, n: int, kind: str, key: str, back: bool) -> Column:
    """A keyed permutation of 0 .. n-1 for an n without useful factors: of all but the last values, then of all but the first."""
    a = int(n**0.5)
    size = a * (n // a)
    first = lambda r: F.when(r < size, feistel(r, a, n // a, F.lit(f"{kind}-1"), key, back)).otherwise(r)
    last = lambda r: F.when(r >= n - size, n - size + feistel(r - (n - size), a, n // a, F.lit(f"{kind}-2"), key, back)).otherwise(r)
    return let(last(rank), first) if back else let(first(rank), last)


def _among(day: Column, months: int, least: int, most: int, key: str, back: bool) -> Column:
    """Permutes the dates of the 400 years whose month is at most `months` (9 or 12) and whose day is from `least` to `most`.

    most is 31 or, with least 1, 9: as many days as a month must have, or as every month has.
    """
    first, year = int(FIRST_DAY[:4]), lambda d: F.year(d) - int(FIRST_DAY[:4])
    kind, skip, start = f"date-{months}-{least}-{most}", least - 1, F.to_date(F.lit(FIRST_DAY))
    if most < 31:
        rank = (year(day) * months + F.month(day) - 1) * most + F.dayofmonth(day) - 1
        made = lambda r: F.make_date(F.call_function("div", r, F.lit(months * most)).cast("int") + first, (F.call_function("div", r, F.lit(most)) % months + 1).cast("int"), (r % most + 1).cast("int"))
        return let(_mixed(rank, 400 * months * most, kind, key, back), made)
    # From January to September a year has 92 days less; every month up to the date's own lacks its first days.
    less = 92 if months == 9 else 0
    n = DAYS_A * DAYS_B - 400 * (less + skip * months)
    rank = F.datediff(day, start) - less * year(day) - skip * (months * year(day) + F.month(day))
    before = lambda y: F.datediff(F.make_date(y + first, F.lit(1), F.lit(1)), start) - (less + skip * months) * y

    def in_year(v: Column) -> Column:
        past = lambda m: F.datediff(F.make_date(v["y"] + first, m, F.lit(1)), F.make_date(v["y"] + first, F.lit(1), F.lit(1))) - skip * (m - 1)
        rest = v["r"] - before(v["y"])
        month = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(months)), lambda m: past(m) <= rest))
        return let(month, lambda m: F.date_add(F.make_date(v["y"] + first, m, F.lit(1)), (rest - past(m) + skip).cast("int")))

    def made(r: Column) -> Column:
        guess = F.call_function("div", r * 400, F.lit(n)).cast("int")
        near = F.filter(F.sequence(F.greatest(guess - 1, F.lit(0)), F.least(guess + 1, F.lit(399))), lambda y: before(y) <= r)
        return let(F.struct(r.alias("r"), F.array_max(near).alias("y")), in_year)

    return let(_mixed(rank, n, kind, key, back), made)


def _date(text: Column, order: str, sign: str, key: str, back: bool) -> Column:
    """order: the parts y, m and d as they stand. Parts keep their widths, so a one-digit month or day is mapped among those.

    Where dates with the day before the month are read only if they make none with the month before the day (order Dmy), they are
    mapped among those, whose day is 13 or more.
    """
    parts = F.split(text, f"[{sign}]")
    at = {c: parts[i] for i, c in enumerate(order.lower())}
    first = F.to_date(F.lit(FIRST_DAY))
    read = F.try_to_date(F.concat_ws("-", at["y"], F.lpad(at["m"], 2, "0"), F.lpad(at["d"], 2, "0")), "yyyy-MM-dd")
    m1, d1 = F.length(at["m"]) == 1, F.length(at["d"]) == 1

    def mapped(day: Column) -> Column:
        gap = F.datediff(day, first)
        if order == "Dmy":
            new = F.when(F.dayofmonth(day) < 13, None).when(m1, _among(day, 9, 13, 31, key, back)).otherwise(_among(day, 12, 13, 31, key, back))
        else:
            new = F.date_add(first, feistel(gap, DAYS_A, DAYS_B, F.lit("date"), key, back).cast("int"))
            new = F.when(m1 & d1, _among(day, 9, 1, 9, key, back)).when(m1, _among(day, 9, 1, 31, key, back)).when(d1, _among(day, 12, 1, 9, key, back)).otherwise(new)
        return F.when((gap >= 0) & (gap < DAYS_A * DAYS_B), new)

    told = {"y": lambda d: _pad(F.year(d), 4), "m": lambda d: _pad(F.month(d), F.length(at["m"])), "d": lambda d: _pad(F.dayofmonth(d), F.length(at["d"]))}
    return let(let(read, mapped), lambda d: F.when(d.isNotNull(), F.concat_ws(sign, *[told[c](d) for c in order.lower()])))


def _ip(text: Column, key: str, back: bool) -> Column:
    def mapped(p: Column) -> Column:
        number = F.aggregate(p, F.lit(0).cast("long"), lambda x, y: x * 256 + y.cast("long"))
        new = feistel(number, 1 << 16, 1 << 16, F.lit("ip"), key, back)
        return let(new, lambda v: F.concat_ws(".", *[(F.shiftright(v, 24 - 8 * i).bitwiseAND(255)).cast("string") for i in range(4)]))

    plain = ~text.rlike(r"(^|\.)0\d") & (F.array_max(F.transform(F.split(text, r"\."), lambda x: x.cast("int"))) <= 255)
    return F.when(plain, let(F.split(text, r"\."), mapped))


def _ssn(text: Column, key: str, back: bool) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.substring(text, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    rank = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    out = lambda v: F.concat_ws("-", _pad(v["a"] + F.when(v["a"] >= 665, 2).otherwise(1), 3), _pad(v["g"] + 1, 2), _pad(v["s"] + 1, 4))
    cut = lambda v: F.struct(F.call_function("div", v, F.lit(99 * 9999)).alias("a"), F.call_function("div", v % (99 * 9999), F.lit(9999)).alias("g"), (v % 9999).alias("s"))
    return F.when(valid, let(feistel(rank, 898, 99 * 9999, F.lit("ssn"), key, back), lambda v: let(cut(v), out)))


def _phone(text: Column, key: str, back: bool) -> Column:
    """Country code and separators stay, the other digits (7 to 14) are permuted."""
    code = F.regexp_extract(text, r"^\+\d{1,3}(?=\D)", 0)
    rest = F.substring(text, F.length(code) + 1, F.length(text))
    n = F.length(_digits(rest))
    return F.when((n >= 7) & (n <= 15), F.concat(code, _filled(rest, _decimal(_digits(rest), "phone", key, back))))


def _chunks(text: Column, pattern: str, radix: int, kind: str, key: str, back: bool) -> Column:
    """Pieces of up to 8 signs of the alphabet are permuted among those of their length; place and case of letters is kept."""
    low = F.lower(text)

    def piece(p: Column, i: Column) -> Column:
        n = F.length(p)
        half = F.call_function("div", n, F.lit(2)).cast("int")
        power = lambda k: F.element_at(F.array(*[F.lit(radix**j).cast("long") for j in range(9)]), k + 1)
        new = feistel(F.conv(p, radix, 10).cast("long"), power(half), power(n - half), F.concat(F.lit(kind), n.cast("string")), key, back)
        return F.when(p.rlike(f"^{pattern}$"), F.lpad(F.lower(F.conv(new.cast("string"), 10, radix)), n, "0")).otherwise(p)

    new = F.array_join(F.transform(F.regexp_extract_all(low, F.lit(f"{pattern}|(?!{pattern})."), F.lit(0)), piece), "")
    return F.when((text == F.upper(text)) & (text != low), F.upper(new)).otherwise(new)


def _email(text: Column, key: str, back: bool) -> Column:
    """The part before the sign is permuted, the host stays. The result is in small letters."""
    name = F.substring_index(text, "@", 1)
    return F.concat(_chunks(F.lower(name), "[a-z0-9]{1,8}", 36, "email", key, back), F.substring(text, F.length(name) + 1, F.length(text)))


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """Struct (kind, text) for a string that ANY has found: kind is null and text unchanged where validation fails."""
    make = {
        "email": lambda: _email(value, key, back),
        "secret": lambda: _chunks(value, "[0-9a-f]{1,8}", 16, "secret", key, back),
        "ip": lambda: _ip(value, key, back),
        "date_iso": lambda: _date(value, "ymd", "-", key, back),
        "date_eu": lambda: _date(value, "dmy", ".", key, back),
        "date_us": lambda: F.coalesce(_date(value, "mdy", "/", key, back), _date(value, "Dmy", "/", key, back)),
        "ssn": lambda: _ssn(value, key, back),
        "phone": lambda: _phone(value, key, back),
        "card": lambda: _number(value, key, back),
        "number": lambda: _number(value, key, back),
    }
    def told(kind: str):
        return lambda v: F.struct(F.when(v.isNotNull(), kind.partition("_")[0]).alias("kind"), F.coalesce(v, value).alias("text"))

    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(rf"^(?:{pattern})$"), let(make[kind](), told(kind))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with text_col rewritten, and n_pii (long) and pii_kinds (sorted array) added; back undoes it.

    A null text stays null and has none; a text without finds is returned as it is. Repeated rows are treated alike. Columns
    named n_pii or pii_kinds are replaced. What fails validation stays and is not counted. The letters of mail names come
    out small, so undoing restores those in small letters.
    """
    text = F.col(text_col)
    # Nothing is found in a text without five digits, an @ or 32 hexadecimal signs: cheap tests before the long pattern.
    found = F.when(text.rlike(r"@|\d{4}|\d[-./) ]{1,2}\(?\d|[0-9a-fA-F]{32}"), F.regexp_extract_all(text, F.lit(f"(?:{ANY})"), F.lit(0)))
    df = docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    df = df.withColumn("_new", F.transform("_found", lambda v: pseudonym(v, key, back)))
    between = F.split(text, f"(?:{ANY})", -1)
    # One piece between finds more than there are finds; the zip pads the last find with null.
    joined = F.array_join(F.zip_with(between, F.col("_new.text"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    df = df.withColumns(
        {
            text_col: F.when(F.size("_found") > 0, joined).otherwise(text),
            "n_pii": F.size(F.filter("_new", lambda x: x["kind"].isNotNull())).cast("long"),
            "pii_kinds": F.sort_array(F.array_distinct(F.array_compact(F.col("_new.kind")))),
        }
    )
    return df.drop("_found", "_new")


def op4_feistel_pseudonyms(spark, sf_dir):
    """Every document with its new text, the number of replaced values and their kinds."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.withColumn("pii_kinds", F.array_join("pii_kinds", ","))


QUERIES = {"op4_feistel_pseudonyms": op4_feistel_pseudonyms}
ORACLE_SQL = {}
