"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in DataFrame functions only.

Found and, where they have a rule, validated: card numbers (Luhn), IBANs (mod 97), social security numbers (area, group,
serial), IPv4 addresses (octets), dates from 1600 to 2399 (calendar), phone numbers with a country code or in a national form
(an area code in brackets or with - or . after it, or a leading 0), e-mail addresses whose local part has 64 characters at
most. What fails its validation is left as it is. Each value is permuted within its format by `ROUNDS` Feistel rounds whose
function is SHA-256 under a secret key, so an equal value gets an equal pseudonym in every document, different values get
different ones, and the result passes the same validation:

* characters, each within its class (digits, ASCII and Latin-1 letters by case, letters of further scripts), halves of the
  string taking turns: cards without their first and check digit, IBANs' own digits, phone numbers after the country code
  or the first digit, the local part of e-mail addresses (one without a character of a class is left alone and not
  counted); check digits are computed anew;
* numbers in a product domain: IPv4 65536 x 65536, SSN 898 x (99 * 9999), the days of 400 years 189 x 773.

A pattern begins only where its run of characters begins, its quantifiers are bounded or possessive: each text takes time
in proportion to its length and the matcher does not recurse, however long a domain or a run of letters or digits is.

Defined results: null stays null, a text without a find is returned as it is; nothing depends on other rows, so repeated
rows, ties and empty tables need no care; very long texts are treated whole; new columns replace those of the same name,
others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ["email", "iban", "ip", "date", "ssn", "phone", "card"]
#: What may stand before and after a number.
_A, _Z = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": _A + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _Z,
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])(?!\p{L})",
    "date": _A + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})" + _Z,
    "ssn": _A + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _Z,
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}" + _Z
    + r"|(?<![\p{L}\p{N}+.-])(?:\([2-9][0-9]{2}\) ?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}([.-])[0-9]{3}\2[0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4})(?![ /.-]?[\p{N}])(?!\p{L})",
    "card": _A + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})" + _Z,
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: Character classes within which a character is permuted: first code point and size. Digits, then letters: ASCII and Latin-1
#: by case, Latin extended, Greek and Cyrillic by case, Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Han, Hangul.
CLASSES = [
    (0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25), (0x410, 32), (0x430, 32),
    (0x531, 38), (0x561, 38), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x905, 53), (0xE01, 46), (0x10D0, 33), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
]


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def product(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Struct l, r: a permutation of the pairs with l < a and r < b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        x = _number(F.substring(_hash(key, F.lit(kind), i, F.when(i % 2 == 0, s["r"]).otherwise(s["l"])), 1, 15))
        return F.struct(F.when(i % 2 == 0, (s["l"] + x % a) % a).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, s["r"]).otherwise((s["r"] + x % b) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _letter(point: Column) -> Column:
    """The character of a code point below 65536."""
    return F.when(point < 256, F.char(point)).otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE"))


def characters(text: Column, key: str, kind: str, classes: list[tuple[int, int]] = CLASSES) -> Column:
    """`text`, its characters permuted within their classes; others stay."""

    def known(c: Column) -> Column:
        point = F.ascii(c)
        first, size = F.lit(0), F.lit(0)
        for a, n in classes:
            inside = (point >= a) & (point < a + n)
            first, size = F.when(inside, a).otherwise(first), F.when(inside, n).otherwise(size)
        return F.struct((point - first).alias("v"), first.alias("first"), size.alias("size"), c.alias("c"))

    every = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), known)

    def permuted(all_: Column) -> Column:
        own = F.filter(all_, lambda x: x["size"] > 0)
        half = F.floor(F.size(own) / 2).cast("int")
        start = F.struct(F.slice(own, F.lit(1), half).alias("l"), F.slice(own, half + 1, F.size(own)).alias("r"))
        value = lambda xs: F.array_join(F.transform(xs, lambda x: (x["v"] + x["first"]).cast("string")), ",")

        def moved(xs: Column, other: Column, i: Column) -> Column:
            # lambda variables are evaluated once: the hash is bound by a one-element array
            def add(h: Column) -> Column:
                return F.transform(
                    xs,
                    lambda x, j: F.struct(((x["v"] + _number(F.substring(h, ((j * 4) % 60 + 1).cast("int"), F.lit(4)))) % x["size"]).cast("int").alias("v"), x["first"].alias("first"), x["size"].alias("size"), x["c"].alias("c")),
                )

            return F.get(F.transform(F.array(_hash(key, F.lit(kind), i, F.size(xs), value(other))), add), F.lit(0))

        def turn(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    def rebuilt(pair: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

        def put(s: Column, x: Column) -> Column:
            own = F.get(pair["new"], s["k"])
            return F.struct(F.concat(s["out"], F.when(x["size"] > 0, _letter(own["v"] + own["first"])).otherwise(x["c"])).alias("out"), (s["k"] + (x["size"] > 0).cast("int")).alias("k"))

        return F.aggregate(pair["old"], start, put, lambda s: s["out"])

    with_new = F.transform(F.array(every), lambda e: F.struct(e.alias("old"), permuted(e).alias("new")))
    return F.get(F.transform(with_new, rebuilt), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(form: Column, new: Column) -> Column:
    """`form` with its digits, in order, replaced by those of `new`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    put = lambda s, c: F.struct(F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(new, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + c.rlike("^[0-9]$").cast("int")).alias("k"))
    return F.aggregate(F.filter(F.split(form, ""), lambda c: c != ""), start, put, lambda s: s["out"])


def luhn(number: Column, shift: int = 0) -> Column:
    """The Luhn sum of a digit string modulo 10; with shift 1, as if a digit 0 followed."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when((i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10


def mod97(text: Column) -> Column:
    def add(s: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, pattern, group)


def _dates(x: Column) -> tuple[Column, Column, Column]:
    """Date of an ISO or day-first string, else of a month-first one, and whether it was month-first."""
    iso = x.rlike("^[0-9]{4}-")
    first, second, year = F.substring(x, 1, 2), F.substring(x, 4, 2), F.substring(x, 7, 4)
    day_first = F.concat_ws("-", year, second, first).try_cast("date")
    month_first = F.when(F.contains(x, F.lit("/")), F.concat_ws("-", year, first, second).try_cast("date"))
    found = F.when(iso, x.try_cast("date")).otherwise(F.coalesce(day_first, month_first))
    return F.when(F.year(found).between(1600, 2399), found), iso, ~iso & day_first.isNull()


def pseudonym(x: Column, key: str) -> Column:
    """Struct kind, new of a find; kind is null if it is not valid, new is then the find itself."""
    whole = {k: x.rlike(f"^(?:{p})$") for k, p in (("email", ".*@.*"), ("ip", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"), ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), ("phone", r"\+.*|\(.*|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}"), ("iban", r"[A-Z]{2}.*"), ("card", r"[0-9 -]*"))}
    octet = lambda i: F.element_at(F.split(x, r"\."), i).cast("int")
    at = F.instr(x, "@")
    local = F.substring(x, F.lit(1), at - 1)
    email = F.concat(characters(local, key, "email"), F.substring(x, at, F.length(x)))
    email_valid = local.rlike("[" + "".join(f"\\x{{{a:x}}}-\\x{{{a + n - 1:x}}}" for a, n in CLASSES) + "]")

    ip = product(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip")
    ip = F.get(F.transform(F.array(ip), lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string"))), F.lit(0))
    ip_valid = (F.greatest(*[octet(i) for i in range(1, 5)]) <= 255)

    date, iso, month_first = _dates(x)
    day = F.datediff(date, F.lit("1600-01-01").cast("date"))
    cycle = F.floor(day / 146097)
    inside = F.pmod(day, F.lit(146097))
    moved = product(F.floor(inside / 773), inside % 773, 189, 773, key, "date")
    new_day = F.get(F.transform(F.array(moved), lambda p: F.date_add(F.lit("1600-01-01").cast("date"), (cycle * 146097 + p["l"] * 773 + p["r"]).cast("int"))), F.lit(0))
    mark = F.substring(x, 3, 1)
    dated = F.get(
        F.transform(
            F.array(new_day),
            lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(month_first, F.concat_ws("/", F.date_format(d, "MM"), F.date_format(d, "dd"), F.date_format(d, "yyyy"))).otherwise(F.concat(F.date_format(d, "dd"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "yyyy"))),
        ),
        F.lit(0),
    )

    area, group, serial = F.substring(x, 1, 3).cast("int"), F.substring(x, 5, 2).cast("int"), F.substring(x, 8, 4).cast("int")
    ssn_valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    ssn = product(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def ssn_text(p: Column) -> Column:
        number = p["l"] + 1
        number = number + (number >= 666).cast("int")
        return F.format_string("%03d-%02d-%04d", number, F.floor(p["r"] / 9999) + 1, p["r"] % 9999 + 1)

    ssn = F.get(F.transform(F.array(ssn), ssn_text), F.lit(0))

    code = _part(x, r"^(\+[0-9]{1,3})", 1)
    code = F.when(x.rlike(r"^\+[0-9]{1,3}[ .(-]"), code).otherwise(F.substring(x, F.lit(1), F.when(x.rlike("^[1-9]"), 1).otherwise(2)))
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    phone = F.concat(code, refilled(rest, characters(digits(rest), key, "phone", CLASSES[:1])))
    phone_valid = F.length(digits(x)).between(8, 15)

    number = digits(x)
    payload = characters(F.substring(number, F.lit(2), F.length(number) - 2), key, "card", CLASSES[:1])
    card = F.get(F.transform(F.array(F.concat(F.substring(number, 1, 1), payload)), lambda n: F.concat(n, ((10 - luhn(n, 1)) % 10).cast("string"))), F.lit(0))
    card = F.get(F.transform(F.array(card), lambda n: refilled(x, n)), F.lit(0))

    plain = F.replace(x, F.lit(" "), F.lit(""))
    own = F.substring(plain, F.lit(5), F.length(plain))
    country = F.substring(plain, 1, 2)
    iban_valid = mod97(F.concat(own, F.substring(plain, 1, 4))) == 1
    new_own = refilled(own, characters(digits(own), key, "iban", CLASSES[:1]))
    iban = F.get(F.transform(F.array(new_own), lambda o: F.concat(country, F.lpad((98 - mod97(F.concat(o, country, F.lit("00")))).cast("string"), 2, "0"), o)), F.lit(0))
    iban = F.get(F.transform(F.array(iban), lambda i: refilled(x, digits(i))), F.lit(0))

    made = {"email": (email_valid, email), "ip": (ip_valid, ip), "date": (date.isNotNull(), dated), "ssn": (ssn_valid, ssn), "phone": (phone_valid, phone), "iban": (iban_valid, iban), "card": (luhn(number) == 0, card)}
    kind, new = F.lit(None).cast("string"), x
    for k in reversed(list(whole)):
        valid, text = made[k]
        kind = F.when(whole[k], F.when(valid, k)).otherwise(kind)
        new = F.when(whole[k], F.when(valid, text).otherwise(x)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymised(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """`docs` with `text` pseudonymised under `key`, and n_email, n_iban, n_ip, n_date, n_ssn, n_phone, n_card (long)."""
    counts = [f"n_{k}" for k in KINDS]
    own = F.col("row")[text]
    some = own.rlike("[0-9@]")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in counts or c == text]).alias("row"))
    out = out.withColumn("found", F.when(some, F.regexp_extract_all(own, F.lit(ANY), F.lit(0))))
    out = out.withColumn("made", F.when(F.size("found") > 0, F.transform("found", lambda x: pseudonym(x, key))))
    joined = F.array_join(F.zip_with(F.split(own, ANY, -1), F.col("made"), lambda gap, x: F.concat(gap, F.coalesce(x["new"], F.lit("")))), "")
    columns = [F.when(F.col("made").isNotNull(), joined).otherwise(own).alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in counts or c == text]
    of = F.transform("made", lambda x: x["kind"])
    return out.select(*columns, *[F.coalesce(F.size(of) - F.size(F.array_remove(of, k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])
