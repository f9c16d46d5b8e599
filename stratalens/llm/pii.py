"""PII: format-preserving Feistel pseudonyms from built-in functions only.

Numbers and dates are found by one pattern, validated by kind and permuted within their format by
a keyed Feistel network: equal values get equal pseudonyms in every document, different values of
a kind stay different, and card numbers keep their Luhn state, addresses and dates stay valid.
The operator is a projection without a shuffle; texts without a digit or ``@`` pass untouched.

Kinds: e-mail (local part); phone (the digits behind the country code, or behind the leading 0 of a
national number; only digits are permuted, so a number written in another grouping gets the same
pseudonym, and a United States number with or without +1 as well); card of 13 to 19 digits with a
valid Luhn digit, which the pseudonym has too; IBAN of the countries in ``IBAN_SIZES`` with valid check
digits (mod 97), which the pseudonym has too; IPv4 address (octets up to 255); social-security number
within the ranges that are issued (area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999), which the
pseudonym keeps; hexadecimal secret of 32 to 64 signs; ISO and day-first date from 1700-05-29 to
2099-08-05. Values of these forms that are not valid stay as they are and are not counted.
Not found: bare national numbers without a leading 0, which no sign tells from other numbers. A number
written nationally in one place and with a country code in another is linked for +1 only.

Defined cases: null text stays null with count 0; values that fail validation stay as they are;
repeated rows give repeated results; empty tables stay empty; further columns are kept unless
they clash with ``pii_counts``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: For tests and demonstrations only: production passes its own secret key.
DEMO_KEY = "stratalens-demo-key"
#: Setting that holds the secret key; the name makes Spark redact it. Without it DEMO_KEY is used.
KEY_SETTING = "spark.stratalens.pii.secret"
ROUNDS = 6  # even, so that the halves end where they began

#: The formats.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3}[ .-]?\d{4}(?!\d)"
ISO_DATE = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])"
DAY_DATE = r"(?<![\d./])\d{2}(?:/\d{2}/|\.\d{2}\.)\d{4}(?![\d/])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])"
HEX = r"(?<![\p{L}\p{N}])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])"
#: Digits with single separators: 8 to 15 behind a plus; national ones by a leading 0, brackets or the usual groups.
#: A phone does not reach into another value behind a separator.
_APART = f"(?!{CARD}|{IPV4}|{ISO_DATE}|{DAY_DATE}|{SSN})"
PLUS_PHONE = r"\+(?=[1-9])(?:\(?\d\)?(?:[ .-]" + _APART + r")?){7,14}\d(?!\d|\.\d)"
_END = r"(?![\d-]|[.,]\d)"
NATIONAL = "|".join((
    r"(?<![\p{L}\d+])\(0?\d{2,5}\)[ .-]?\d{3,4}(?:(?:[ .-]" + _APART + r")?\d{2,5}){1,2}" + _END,
    r"(?<![\p{L}\d+.,/-])0\d(?=(?:[ /-]?\d){6})\d{0,3}[ /-]\d{3,8}(?:[ -]" + _APART + r"\d{2,5}){0,2}" + _END,
    r"(?<![\p{L}\d+.,/-])0[1-9](?:(?:[ .-]\d{2}){4}|\d{8,9})" + _END,
    r"(?<![\p{L}\d+.,/-])[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}" + _END,
    r"(?<![\p{L}\d+.,/-])(?:[6-9]\d{2} \d{3} \d{3}|[6-9]\d{2}(?: \d{2}){3}|9\d \d{3} \d{2} \d{2})(?! ?\d)" + _END,
))
#: Country codes by their first digits.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Signs of an account number by country.
IBAN_SIZES = {15: "NO", 16: "BE", 18: "DK|FI|NL", 20: "AT|EE|LT|LU", 21: "CH|HR|LI|LV", 22: "BG|DE|GB|IE", 24: "CZ|ES|RO|SE|SK", 25: "PT", 26: "TR", 27: "FR|GR|IT|MC", 28: "CY|HU|PL"}
IBAN = r"(?<![\p{L}\p{N}])(?:" + "|".join(rf"(?:{c})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIZES.items()) + r")(?![\p{L}\p{N}])"
PATTERN = "|".join((EMAIL, PHONE, PLUS_PHONE, ISO_DATE, DAY_DATE, IPV4, SSN, HEX, CARD, IBAN, NATIONAL))

KINDS = ("email", "phone", "date", "ip", "ssn", "card", "secret")


def _hash(key: Column, kind: str, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", key, F.lit(kind), r.cast("string"), half), 256)


def _number(digest: Column, at: Column | int, below: int) -> Column:
    """A number below ``below`` from seven hexadecimal digits of a digest."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, at, F.lit(7)), 16, 10).cast("long") % below


def _shifted(half: Column, digest: Column, letters: int) -> Column:
    """Every digit moves within digits, every ASCII letter within its case; other signs stay."""

    def move(c: Column, i: Column) -> Column:
        s = _number(digest, i % 57 + 1, 10 * letters)
        code = F.ascii(c)
        turned = lambda base, size: F.char(((code - base + s) % size + base).cast("long"))
        return (
            F.when((code >= 48) & (code <= 57), turned(48, 10))
            .when((code >= 97) & (code < 97 + letters), turned(97, letters))
            .when((code >= 65) & (code < 65 + letters), turned(65, letters))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permuted(value: Column, key: Column, kind: str, letters: int = 26) -> Column:
    """Feistel network over the halves of a string; the halves' lengths may differ by one."""

    def on(v: Column) -> Column:
        n = F.length(v)
        start = F.struct(F.substring(v, F.lit(1), F.floor(n / 2).cast("int")).alias("a"), F.substring(v, F.floor(n / 2).cast("int") + 1, n).alias("b"))
        step = lambda h, r: F.struct(h["b"].alias("a"), _shifted(h["a"], _hash(key, f"{kind}", r, F.concat_ws("/", n.cast("string"), F.lower(h["b"]))), letters).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda h: F.concat(h["a"], h["b"]))

    return let(value, on)


def permuted_pair(a: Column, b: Column, key: Column, kind: str, below: int) -> Column:
    """Feistel network over two numbers below ``below``; the result is their struct (a, b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda h, r: F.struct(h["b"].alias("a"), ((h["a"] + _number(_hash(key, kind, r, h["b"].cast("string")), 1, below)) % below).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` with it a valid number."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    digits = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    return (10 - F.aggregate(F.transform(digits, worth), F.lit(0), lambda s, x: s + x) % 10) % 10


def _in_form(form: Column, signs: Column, kind: str = r"\d") -> Column:
    """``signs`` set into the places of the signs of a kind in ``form``."""
    other = rf"[^{kind}]"
    place = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), other, ""))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike(rf"^[{kind}]$"), F.substring(signs, place(i), F.lit(1))).otherwise(c)), "")


def _luhn_rest(digits: Column) -> Column:
    """What the last digit is above the valid check digit: 0 for a valid number."""
    return F.substring(digits, F.length(digits), F.lit(1)).cast("int") - luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))


def _is_card(value: Column) -> Column:
    return let(F.regexp_replace(value, r"\D", ""), lambda d: _luhn_rest(d) == 0)


def _card(value: Column, key: Column) -> Column:
    def on(v: Column) -> Column:
        digits = F.regexp_replace(v, r"\D", "")
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        return let(permuted(body, key, "card"), lambda new: _in_form(v, F.concat(new, luhn_digit(new).cast("string"))))

    return let(value, on)


def _phone(value: Column, key: Column) -> Column:
    """Country code, or the 0 of a national number, then the other digits in their places."""

    def on(v: Column) -> Column:
        digits = F.regexp_replace(v, r"\D", "")
        code = F.when(v.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).when(digits.startswith("0"), "0").otherwise("")
        return let(F.struct(digits.alias("d"), code.alias("c")), lambda x: _in_form(v, F.concat(x["c"], permuted(F.substring(x["d"], F.length(x["c"]) + 1, F.length(x["d"])), key, "phone"))))

    return let(value, on)


def _is_ssn(value: Column) -> Column:
    return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")


def _ssn(value: Column, key: Column) -> Column:
    """The areas and groups in one number and the serials in another change places in turns."""
    groups, serials = 898 * 99, 9999

    def on(v: Column) -> Column:
        part = lambda at, size: F.substring(v, at, size).cast("long")
        area = part(1, 3)
        area = F.when(area > 666, area - 2).otherwise(area - 1)
        start = F.struct((area * 99 + part(5, 2) - 1).alias("a"), (part(8, 4) - 1).alias("b"))

        def step(h: Column, r: Column) -> Column:
            a, b = F.when(r % 2 == 1, (h["a"] + _number(_hash(key, "ssn", r, h["b"].cast("string")), 1, groups)) % groups).otherwise(h["a"]), h["b"]
            return F.struct(a.alias("a"), F.when(r % 2 == 0, (b + _number(_hash(key, "ssn", r, h["a"].cast("string")), 1, serials)) % serials).otherwise(b).alias("b"))

        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        made = lambda x: let(F.floor(x["a"] / 99), lambda c: F.concat_ws("-", pad(F.when(c >= 665, c + 2).otherwise(c + 1), 3), pad(x["a"] % 99 + 1, 2), pad(x["b"] + 1, 4)))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), made)

    return let(value, on)


def _iban_check(bare: Column) -> Column:
    """The two check digits that make an account number without blanks valid (mod 97)."""
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 2), F.lit("00"))
    worth = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
    rest = F.aggregate(F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), worth), F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _is_iban(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda b: F.substring(b, 3, 2) == _iban_check(b))


def _iban(value: Column, key: Column) -> Column:
    """The country stays, the rest is permuted with its blanks in place, the check digits follow."""

    def on(v: Column) -> Column:
        bare = F.replace(v, F.lit(" "), F.lit(""))
        made = F.concat(F.substring(bare, 1, 4), permuted(F.substring(bare, F.lit(5), F.length(bare)), key, "iban"))
        return let(made, lambda w: _in_form(v, F.concat(F.substring(w, 1, 2), _iban_check(w), F.substring(w, F.lit(5), F.length(w))), "A-Z0-9"))

    return let(value, on)


def _ip(value: Column, key: Column) -> Column:
    def on(o: Column) -> Column:
        p = permuted_pair(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), key, "ip", 65536)
        part = lambda h: [F.floor(h / 256).cast("string"), (h % 256).cast("string")]
        made = let(p, lambda x: F.concat_ws(".", *part(x["a"]), *part(x["b"])))
        return F.when(F.exists(o, lambda x: x.cast("int") > 255), F.array_join(o, ".")).otherwise(made)

    return let(F.split(value, r"\."), on)


def _date(value: Column, key: Column, form: str) -> Column:
    def on(v: Column) -> Column:
        day = F.datediff(F.try_to_timestamp(v, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))
        span = 270 * 270  # days of either range, from 1900 on and before
        first = F.when(day < 0, -span).otherwise(0)
        p = permuted_pair(F.floor((day - first) / 270), (day - first) % 270, key, "date", 270)
        made = let(p, lambda x: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (x["a"] * 270 + x["b"] + first).cast("int")), form))
        return F.when((day >= -span) & (day < span), made).otherwise(v)

    return let(value, on)


def kind_of(m: Column) -> Column:
    """The kind of a value that is valid, else null."""
    day = lambda form: F.try_to_timestamp(m, F.lit(form)).cast("date").between(F.lit("1700-05-29").cast("date"), F.lit("2099-08-05").cast("date"))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[+(]"), "phone")
        .when(m.rlike(r"^\d+-\d\d-\d\d$"), F.when(day("yyyy-MM-dd"), "date"))
        .when(m.rlike(r"^\d\d/\d\d/\d{4}$"), F.when(day("dd/MM/yyyy"), "date"))
        .when(m.rlike(r"^\d\d\.\d\d\.\d{4}$"), F.when(day("dd.MM.yyyy"), "date"))
        .when(m.rlike(r"^(\d+\.){3}\d{1,3}$"), F.when(~m.rlike(r"(?:^|\.)(?:25[6-9]|2[6-9]\d|[3-9]\d\d)(?:\.|$)"), "ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(_is_ssn(m), "ssn"))
        .when(m.rlike("^(?=.*[a-fA-F])[0-9a-fA-F]{32,64}$"), "secret")
        .when(m.rlike("^[A-Z]"), F.when(_is_iban(m) | F.coalesce(_is_card(F.nullif(F.regexp_extract(m, f"({CARD})", 1), F.lit(""))), F.lit(False)), "card"))
        .when(m.rlike(f"^(?:{CARD})$"), F.when(_is_card(m), "card"))
        .otherwise("phone")
    )


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    cut = lambda pattern, g: F.regexp_extract(m, pattern, g)
    email = r"^(.*)(@[^@]*)$"
    card = f"^(.*?)({CARD})(.*)$"  # of what is no valid IBAN
    return (
        F.when(kind.isNull(), m)
        .when(kind == "email", F.concat(permuted(cut(email, 1), key, "email"), cut(email, 2)))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "date", F.when(m.contains("-"), _date(m, key, "yyyy-MM-dd")).when(m.contains("/"), _date(m, key, "dd/MM/yyyy")).otherwise(_date(m, key, "dd.MM.yyyy")))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "secret", permuted(m, key, "secret", 6))
        .when(m.rlike("^[A-Z]"), F.when(_is_iban(m), _iban(m, key)).otherwise(F.concat(cut(card, 1), _card(cut(card, 2), key), cut(card, 3))))
        .otherwise(_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``pii_counts``, a map from kind to its number."""
    k = F.lit(key or docs.sparkSession.conf.get(KEY_SETTING, DEMO_KEY))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "pii_counts"]

    def rebuilt(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
        kinds = lambda f: F.transform(f, lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
        made = lambda f: F.transform(f, lambda x: F.struct(pseudonym(x["m"], x["k"], k).alias("p"), x["k"].alias("k")))
        join = lambda f: F.array_join(F.zip_with(F.split(t, PATTERN, -1), F.transform(f, lambda x: x["p"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return let(found, lambda f: F.when(F.size(f) == 0, F.struct(t.alias("t"), F.array().cast("array<string>").alias("k"))).otherwise(let(made(kinds(f)), lambda x: F.struct(join(x).alias("t"), F.transform(x, lambda y: y["k"]).alias("k")))))

    source = F.col(f"`{text}`")
    out = F.when(source.rlike("[0-9@]"), let(source, rebuilt)).otherwise(F.struct(source.alias("t"), F.array().cast("array<string>").alias("k")))
    counts = F.map_from_entries(F.filter(F.transform(F.array(*[F.lit(x) for x in KINDS]), lambda c: F.struct(c.alias("key"), F.size(F.filter(F.col("_pii.k"), lambda x: x == c)).cast("long").alias("value"))), lambda e: e["value"] > 0))
    return docs.select(*kept, out.alias("_pii")).select(*[F.col("_pii.t").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() != "pii_counts"], counts.alias("pii_counts"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    out = pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.coalesce(F.element_at("pii_counts", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", *counts)
