"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in DataFrame expressions.

Recognised and validated: card numbers (Luhn), IBANs (mod 97), IPv4 addresses, dates, social security numbers, phone
numbers, e-mail addresses and long hexadecimal secrets. A value is a vector of symbols, each with its own radix: a
digit stays a digit, a letter keeps its case. Separators are taken out before and written back after, so a value has the
same pseudonym however it is grouped. A Feistel network alternately shifts one half of the vector by a keyed SHA-256 of
the other half, modulo each symbol's radix, which is a permutation of all values of the format. Check digits are
computed anew, so a valid number stays valid; dates are permuted among the days of two centuries, and numbers with
forbidden values are walked on until a valid one comes. A phone number's country code stays and isn't part of what is
permuted. Equal values get equal pseudonyms in all documents; other numbers are left as they are. Dates written with
slashes are months first; where the first number is above twelve they are days first, and such days are permuted among
themselves.

The caller's key isn't part of the plan, but a key derived from it is, and whoever has that can undo the pseudonyms:
protect event logs and the UI of such jobs like the key.

Only built-in expressions are used. A null text stays null, an empty text empty; rows that are repeated get the same
result; an empty table gives no rows; other columns stay, but for those named like a result column, which the result
replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import fresh
from scrivener.session import prepare

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind and pattern, in the order in which they are tried at a place. Numbers start with a digit, + or (.
NUMBERS = {
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iso": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "dotted": r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)",
    "slashed": r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # After +1 ten digits, after another code eight to thirteen with it, so that a year behind a number isn't its end.
    "phone": r"(?<![\d+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]{0,2}\d{3}[ .-]?\d{4}|\+(?:[ .()-]{0,2}\d){8,13}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    # Groups of four, or of four, six and five, or none: numbers beside a card number don't belong to it.
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
#: Country codes: one, two or three digits.
COUNTRY_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
PATTERNS = {
    # A name has 64 characters at most and a host 127 labels: Java's matcher recurses in repeated groups.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}",
    "iban": r"(?=[A-Z]{2}\d\d)(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?=[0-9a-f]{26})(?<![\p{L}\p{N}])[0-9a-f]{26,64}(?![\p{L}\p{N}])",
    **NUMBERS,
}
#: One cheap look at a character rules out most places before any pattern is tried. E-mail is tried where there is an @.
WITHOUT_EMAIL = f"{PATTERNS['iban']}|{PATTERNS['secret']}|(?=[0-9+(])(?:{'|'.join(f'(?:{p})' for p in NUMBERS.values())})"
WITH_EMAIL = f"{PATTERNS['email']}|{WITHOUT_EMAIL}"
#: First character and number of the characters that replace each other.
ALPHABETS = (("0", 10), ("a", 26), ("A", 26), ("à", 23), ("ø", 8), ("À", 23), ("Ø", 7))
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73049, 271
#: Steps of a walk to a valid value at the most, and the number that stands for one that isn't found by then.
STEPS, NO_NUMBER = 64, "219-09-9999"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(xs: Column, radixes: Column, key: str, tweak: str) -> Column:
    """Permutes the vectors xs of symbols 0 <= x < radix; a symbol of radix 1 stays."""

    def rounds(s: Column) -> Column:
        half = s["h"]

        def one_round(x: Column, k: Column) -> Column:
            other = F.when(k % 2 == 0, F.slice(x, half + 1, F.size(x) - half)).otherwise(F.slice(x, F.lit(1), half))

            def shifted(told: Column, v: Column, i: Column) -> Column:
                by = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), k, i, told), 256), 1, 12), 16, 10).cast("long")
                return F.when(((i < half) == (k % 2 == 0)) & (F.get(s["r"], i) > 1), F.pmod(v + by, F.get(s["r"], i)).cast("int")).otherwise(v)

            return let(F.array_join(other, ","), lambda told: F.transform(x, lambda v, i: shifted(told, v, i)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s["x"], one_round)

    return let(xs, lambda x: let(F.struct(x.alias("x"), radixes.alias("r"), F.floor(F.size(x) / 2).cast("int").alias("h")), rounds))


def _chars(m: Column) -> Column:
    return F.filter(F.split(m, ""), lambda c: c != "")


def _offset(c: Column) -> Column:
    """First character of the alphabet that c is in; else null."""
    out = F.lit(None).cast("int")
    for first, n in ALPHABETS:
        out = F.when((F.ascii(c) >= ord(first)) & (F.ascii(c) < ord(first) + n), F.lit(ord(first))).otherwise(out)
    return out


def _radix(c: Column) -> Column:
    out = F.lit(1)
    for first, n in ALPHABETS:
        out = F.when((F.ascii(c) >= ord(first)) & (F.ascii(c) < ord(first) + n), F.lit(n)).otherwise(out)
    return out


def permuted(m: Column, key: str, tweak: str, fixed: int = 0) -> Column:
    """The text with its letters and digits permuted within their alphabets, but for the first `fixed` of them."""

    def body(chars: Column) -> Column:
        return let(F.filter(chars, lambda c: _offset(c).isNotNull()), lambda core: laid_back(chars, core))

    def laid_back(chars: Column, core: Column) -> Column:
        xs = F.transform(core, lambda c: F.ascii(c) - _offset(c))
        radixes = F.transform(core, lambda c, i: F.when(i < fixed, F.lit(1)).otherwise(_radix(c)))
        written = lambda new: F.transform(core, lambda c, i: F.char(F.get(new, i) + _offset(c)))

        def place(s: Column, c: Column, new: Column) -> Column:
            own = _offset(c).isNotNull()
            return F.struct((s["n"] + own.cast("int")).alias("n"), F.concat(s["out"], F.when(own, F.get(new, s["n"])).otherwise(c)).alias("out"))

        start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
        return let(let(feistel(xs, radixes, key, tweak), written), lambda new: F.aggregate(chars, start, lambda s, c: place(s, c, new), lambda s: s["out"]))

    return let(_chars(m), body)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit text whose last digit is the check digit."""
    backwards = F.transform(_chars(F.reverse(digits)), lambda c: c.cast("int"))
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def mod97(m: Column) -> Column:
    """Remainder of a text of digits and capitals (A is 10, Z is 35)."""
    return F.aggregate(
        _chars(m), F.lit(0), lambda a, c: F.when(F.ascii(c) < 65, F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    )


def _card(m: Column, key: str) -> Column:
    """All but the first and the check digit are permuted."""
    body = permuted(F.substring(m, F.lit(1), F.length(m) - 1), key, "card", 1)
    check = lambda x: F.pmod(-luhn_sum(F.concat(_digits(x), F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn_sum(_digits(m)) % 10 == 0, let(body, lambda x: F.concat(x, check(x)))).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    valid = mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
    body = permuted(F.substring(m, F.lit(5), F.length(m)), key, "iban")
    check = lambda x: 98 - mod97(F.concat(F.replace(x, F.lit(" "), F.lit("")), F.substring(m, 1, 2), F.lit("00")))
    return F.when(valid, let(body, lambda x: F.concat(F.substring(m, 1, 2), F.lpad(check(x).cast("string"), 2, "0"), x))).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256), 4), key, "ip"), lambda x: x.cast("string")), ".")


def _day(m: Column, style: str) -> Column:
    return F.datediff(F.try_to_date(m, style), F.lit(FIRST_DAY).cast("date"))


def _date(m: Column, key: str, style: str, among: Callable[[Column], Column] | None = None) -> Column:
    """Days from 1900 to 2099, or those that `among` names, are permuted among themselves; the style is kept."""

    def value(s: Column) -> Column:
        return F.get(s["x"], F.lit(0)) * SIDE + F.get(s["x"], F.lit(1))

    def dated(v: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), v)

    def valid(s: Column) -> Column:
        return (value(s) < DAYS) & (among(dated(value(s))) if among else F.lit(True))

    def walk(s: Column, _: Column) -> Column:
        step = F.struct(feistel(s["x"], F.array_repeat(F.lit(SIDE), 2), key, "date").alias("x"), (s["n"] + 1).alias("n"))
        return F.when((s["n"] > 0) & valid(s), s).otherwise(step)

    def body(day: Column) -> Column:
        start = F.struct(F.array(F.floor(day / SIDE).cast("int"), (day % SIDE).cast("int")).alias("x"), F.lit(0).alias("n"))
        new = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, walk, lambda s: F.when(valid(s), value(s)).otherwise(F.lit(30)))
        return F.when((day >= 0) & (day < DAYS), F.date_format(dated(new), style)).otherwise(m)

    return let(_day(m, style), body)


def _slashed(m: Column, key: str) -> Column:
    days_first = _date(m, key, "dd/MM/yyyy", lambda d: F.dayofmonth(d) > 12)
    return F.when(_day(m, "MM/dd/yyyy").isNotNull(), _date(m, key, "MM/dd/yyyy")).otherwise(days_first)


def _ssn(m: Column, key: str) -> Column:
    def valid(x: Column) -> Column:
        return ~x.rlike("^(?:000|666|9)|-00-|-0000$")

    def walk(s: Column, _: Column) -> Column:
        return F.when((s["n"] > 0) & valid(s["x"]), s).otherwise(F.struct(permuted(s["x"], key, "ssn").alias("x"), (s["n"] + 1).alias("n")))

    start = F.struct(m.alias("x"), F.lit(0).alias("n"))
    new = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, walk, lambda s: F.when(valid(s["x"]), s["x"]).otherwise(NO_NUMBER))
    return F.when(valid(m), new).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(m, COUNTRY_CODE, 0)
    return F.concat(code, permuted(F.substring(m, F.length(code) + 1, F.length(m)), key, "phone"))


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permuted(name, key, "email"), F.substring(m, F.length(name) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    """Digits stay digits and the letters a to f are permuted among themselves."""

    def body(chars: Column) -> Column:
        xs = F.transform(chars, lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 97))
        radixes = F.transform(chars, lambda c: F.when(F.ascii(c) < 58, F.lit(10)).otherwise(F.lit(6)))
        written = lambda new: F.transform(chars, lambda c, i: F.char(F.get(new, i) + F.when(F.ascii(c) < 58, F.lit(48)).otherwise(F.lit(97))))
        return let(feistel(xs, radixes, key, "secret"), lambda new: F.array_join(written(new), ""))

    return F.when(m.rlike("[0-9]") & m.rlike("[a-f]"), let(_chars(m), body)).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a text that matches one of the patterns; itself if it isn't valid."""
    how = {
        "email": _email, "iban": _iban, "secret": _secret, "ip": _ip,
        "iso": lambda m, k: _date(m, k, "yyyy-MM-dd"), "dotted": lambda m, k: _date(m, k, "dd.MM.yyyy"), "slashed": _slashed,
        "ssn": _ssn, "phone": _phone, "card": _card,
    }
    out = m
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), how[kind](m, key)).otherwise(out)
    return out


def derived(key: str) -> str:
    """What stands for the key in the plan."""
    return hashlib.sha256(f"pseudonyms|{key}".encode()).hexdigest()


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with pseudonyms in its text, and n_pseudonyms: how many values were replaced. The key must be kept secret."""
    prepare(docs.sparkSession)
    key = derived(key)
    found, new = fresh(docs, "found"), fresh(docs, "new")
    has_at, has_digit = F.col(text).contains("@"), F.col(text).rlike("[0-9]")

    def by_pattern(f: Callable[[str], Column]) -> Column:
        return F.when(has_at, f(WITH_EMAIL)).when(has_digit, f(WITHOUT_EMAIL))

    marked = docs.withColumn(found, by_pattern(lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))))
    marked = marked.withColumn(found, F.when(F.size(found) > 0, F.col(found)))
    marked = marked.withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    around = by_pattern(lambda p: F.split(F.col(text), p, -1))
    joined = F.array_join(F.transform(around, lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.lit("")))), "")
    changed = F.coalesce(F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)), F.lit(0))
    out = marked.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(joined))
    return out.withColumn("n_pseudonyms", F.when(F.col(found).isNull(), F.lit(0)).otherwise(changed).cast("long")).drop(found, new)
