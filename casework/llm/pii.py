"""Personal data by format-preserving pseudonyms: keyed permutations of each format onto itself.

Numbers and dates that pass their format's own test (check digit, value ranges, calendar) are replaced by others of the same
format through a Feistel network keyed with a secret, so equal values become equal pseudonyms in all documents, different
ones stay different, and the replacement passes the same test. What fails its test is no such number and stays. Punctuation
stays in place, and a number is permuted by its digits, however it is punctuated. DataFrame expressions only.

| kind | permuted | stays |
| card | all digits but the last, which is the check digit anew | length, grouping |
| phone | all digits after the country code | country code, punctuation |
| date, dashes | any day of 271 * 271 from 1900-01-01 on | notation |
| date, slashes | years 1900 to 2101 and days, among those that read both ways, have days 13 to 28, later days, or are February 29 | order of day and month, where it shows |
| ssn | within the areas, groups and serials that are issued | dashes |
| ip | all four octets | dots |
| email | letters and digits in front of the @, case kept | domain |

``01/05/2020`` may be a day of January or of May, so dates that read both ways are permuted as texts among themselves.

Defined cases: null text stays null with count 0; texts without any match are returned as they are; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import free_names

ROUNDS = 10
FIRST_DAY = "1900-01-01"
SIDE = 271  # SIDE * SIDE days
FIRST_YEAR, YEARS = 1900, 202  # of dates with slashes; 7 * 7 of these years have a February 29
LATE = [f"{m:02}/{d}" for m in range(1, 13) if m != 2 for d in ((29, 30) if m in (4, 6, 9, 11) else (29, 30, 31))]

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "date": r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
}
ANY = "(" + "|".join(PATTERNS.values()) + ")"


def _random(key: str, *parts: Column | int | str) -> Column:
    """64 hexadecimal digits from the key and the parts."""
    lit = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in lit]).cast("binary"), 256)


def _number(hexadecimal: Column, digits: int = 12) -> Column:
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("bigint")


def permuted_pair(a: Column, b: Column, m: Column | int, n: Column | int, key: str, kind: Column | str) -> Column:
    """A keyed permutation of pairs with 0 <= a < m and 0 <= b < n, as a struct (a, b)."""

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (x["a"] + _number(_random(key, kind, i, x["b"]))) % m).otherwise(x["a"]).alias("a"),
            F.when(even, x["b"]).otherwise((x["b"] + _number(_random(key, kind, i, x["a"]))) % n).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _characters(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def permuted_text(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of texts with the same pattern of digits, small and capital letters."""

    def shifted(half: Column, hexadecimal: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(hexadecimal, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            moved = lambda first, n: F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + by) % n)
            return F.when(c.between("0", "9"), moved("0", 10)).when(c.between("a", "z"), moved("a", 26)).when(c.between("A", "Z"), moved("A", 26)).otherwise(c)

        return F.array_join(F.transform(_characters(half), one), "")

    def step(x: Column, i: Column) -> Column:
        return F.struct(x["b"].alias("a"), shifted(x["a"], _random(key, kind, F.length(s), i, x["b"])).alias("b"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(done["a"], done["b"])


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the digits with every other one doubled, from the right."""
    doubled = lambda i: (F.length(digits) - i) % 2 == (0 if double_last else 1)
    d = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(doubled(i), F.when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i))).otherwise(d(i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _refilled(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in order."""

    def add(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["out"], F.when(digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k")
        )

    return F.aggregate(_characters(template), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), add)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = permuted_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    checked = F.aggregate(F.array(body), F.lit(""), lambda a, b: F.concat(a, b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string")))
    return F.when(luhn_sum(d, False) % 10 == 0, _refilled(m, checked)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+(\d{1,3})", 1)
    d = _digits(m)
    rest = F.substring(d, F.length(country) + 1, F.length(d))
    return _refilled(m, F.concat(country, permuted_text(rest, key, "phone")))


def _ip(m: Column, key: str) -> Column:
    o = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("int")
    valid = (o(0) < 256) & (o(1) < 256) & (o(2) < 256) & (o(3) < 256)
    p = permuted_pair(o(0) * 256 + o(1), o(2) * 256 + o(3), 1 << 16, 1 << 16, key, "ip")
    text = F.aggregate(
        F.array(p), F.lit(""),
        lambda a, x: F.concat(a, F.concat_ws(".", *[v.cast("string") for v in (F.shiftright(x["a"], 8), x["a"] % 256, F.shiftright(x["b"], 8), x["b"] % 256)])),
    )
    return F.when(valid, text).otherwise(m)


def _date(m: Column, key: str) -> Column:
    day = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    p = permuted_pair(F.floor(number / SIDE), number % SIDE, SIDE, SIDE, key, "date")
    new = F.aggregate(F.array(p), F.lit(0).cast("bigint"), lambda a, x: a + x["a"] * SIDE + x["b"])
    text = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), "yyyy-MM-dd")
    dashed = F.when(day.isNotNull() & (number >= 0) & (number < SIDE * SIDE), text)
    return F.coalesce(F.when(F.contains(m, F.lit("-")), dashed).otherwise(_slash_date(m, key)), m)


def _slash_date(m: Column, key: str) -> Column:
    """Each group of dates is a product of years and days, so that a permuted pair is a date of the same group; null if it is no date."""
    part = lambda i: F.get(F.split(m, "/"), F.lit(i)).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    first, second, year = part(0), part(1), part(2) - FIRST_YEAR
    month, day = F.least(first, second), F.greatest(first, second)
    late = F.array_position(F.array(*map(F.lit, LATE)), F.concat_ws("/", two(month), two(day))).cast("int") - 1
    leap = (year > 0) & (year % 4 == 0) & (year != 200)
    group = (
        F.when(~year.between(0, YEARS - 1) | (month < 1) | (month > 12), None).when(day <= 12, "both").when(day <= 28, "early")
        .when(late >= 0, "late").when((month == 2) & (day == 29) & leap, "leap")
    )
    of = lambda both, early, late, leap: F.when(group == "both", both).when(group == "early", early).when(group == "late", late).otherwise(leap)
    slot = of((first - 1) * 12 + second - 1, (month - 1) * 16 + day - 13, late, F.floor(year / 4 - 1).cast("int") % 7)
    row = of(year, year, year, F.floor((year / 4 - 1) / 7).cast("int"))
    p = permuted_pair(row, slot, of(YEARS, YEARS, YEARS, 7), of(144, 192, len(LATE), 7), key, F.concat(F.lit("date "), group))

    def text(x: Column) -> Column:
        md = of(
            F.concat_ws("/", two(F.floor(x["b"] / 12) + 1), two(x["b"] % 12 + 1)), F.concat_ws("/", two(F.floor(x["b"] / 16) + 1), two(x["b"] % 16 + 13)),
            F.get(F.array(*map(F.lit, LATE)), x["b"].cast("int")), F.lit("02/29"),
        )
        turned = F.when((group == "both") | (first < second), md).otherwise(F.concat_ws("/", F.substring(md, 4, 2), F.substring(md, 1, 2)))
        return F.concat_ws("/", turned, (of(x["a"], x["a"], x["a"], (x["a"] * 7 + x["b"]) * 4 + 4) + FIRST_YEAR).cast("string"))

    return F.when(group.isNotNull(), F.aggregate(F.array(p), F.lit(""), lambda acc, x: F.concat(acc, text(x))))


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, "-"), F.lit(i)).cast("int")
    valid = (part(0) > 0) & (part(0) < 900) & (part(0) != 666) & (part(1) > 0) & (part(2) > 0)
    area = F.when(part(0) < 666, part(0) - 1).otherwise(part(0) - 2)  # 0 to 897
    p = permuted_pair(area * 99 + part(1) - 1, part(2) - 1, 898 * 99, 9999, key, "ssn")

    def text(x: Column) -> Column:
        a = F.floor(x["a"] / 99)
        return F.concat_ws(
            "-", F.lpad((F.when(a < 665, a + 1).otherwise(a + 2)).cast("string"), 3, "0"), F.lpad((x["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["b"] + 1).cast("string"), 4, "0")
        )

    return F.when(valid, F.aggregate(F.array(p), F.lit(""), lambda acc, x: F.concat(acc, text(x)))).otherwise(m)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ANY, or the match itself if it is not valid."""
    full = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(full("email"), _email(m, key)).when(full("ip"), _ip(m, key)).when(full("date"), _date(m, key)).when(full("ssn"), _ssn(m, key))
        .when(full("phone"), _phone(m, key)).when(full("card"), _card(m, key)).otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text", out: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and __replaced: a struct (old, new) of what was replaced, in order."""
    found = F.when(F.col(text).rlike(ANY), F.regexp_extract_all(F.col(text), F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    found_name, new_name = free_names(docs, "found", "new")
    df = docs.withColumn(found_name, F.coalesce(found, F.array().cast("array<string>")))
    df = df.withColumn(new_name, F.transform(found_name, lambda m: pseudonym(m, key)))
    gaps = F.split(F.col(text), ANY, -1)
    whole = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(new_name, i), F.lit(""))))), "")
    pairs = F.filter(F.transform(found_name, lambda m, i: F.struct(m.alias("old"), F.get(new_name, i).alias("new"))), lambda x: x["old"] != x["new"])
    return df.withColumn("__replaced", pairs).withColumn(out, F.when(F.size(found_name) > 0, whole).otherwise(F.col(text))).drop(found_name, new_name)
