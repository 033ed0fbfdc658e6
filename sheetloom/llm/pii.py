"""Format-preserving pseudonyms for personal data, in SQL functions alone.

One pattern finds candidates: e-mail addresses, phone numbers, payment cards, bank accounts (IBAN), social security numbers, IPv4 addresses, dates and
credentials (access key ids, values after password-like names, long hexadecimal secrets). A candidate counts only if it is valid: cards by their check digit,
accounts by their check number, addresses by octets up to 255, dates by the calendar from 1900 to 2099.

A valid value is turned into fields with a radix each (ten for a digit, 26 for a letter, 256 for an octet and so on) and permuted by an eight-round Feistel
network over the two halves of the fields: in each round a keyed SHA-256 of one half is added to the other, field by field and modulo its radix. That is
a permutation of the format: the pseudonym is of the same kind, passes the same check, and equal values get equal pseudonyms in all documents. Separators, country
codes, mail domains, the first digit of a card and the names before credentials stay; check digits are computed anew. Dates with equal days agree whatever their notation.

A card or account number with more digits or letters behind it counts as far as it is valid: the longest valid beginning that ends at a separator.

Defined results: missing and empty texts stay as they are; invalid candidates stay; a value without anything to permute stays; values have no upper length, and
texts of any length are searched whole; repeated rows get equal results; an empty table gives none; rows and other columns stay, a column ``n_values`` is replaced.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.common import query, table

KEY_SETTING = "sheetloom.pseudonym.key"
ROUNDS = 8
DAYS, DAY_RADICES = 73049, (4297, 17)  # the days of 1900 to 2099, and two radices whose product they are

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z0-9-]*[A-Za-z]",
    "credential": r"(?<![A-Za-z0-9_])(?:password|passwd|pwd|secret|token|api_key)[=:][^\s\"',;&]{4,}+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9]{7,12}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[/.:][0-9])",
}
ANY = "|".join(PATTERNS.values())
# What every candidate holds: a digit, a mail sign or the mark behind a name, or the start of a key id.
HINT = "[0-9@=:]|AKIA"
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEXADECIMAL = "0123456789abcdef"
FIELD = "array<struct<v:int,m:int>>"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _added(half: Column, other: Column, round_: Column, key: str) -> Column:
    """Every field of a half plus a keyed digest of the other half, modulo its radix."""
    of = F.concat_ws("|", F.lit(key), round_.cast("string"), F.size(half).cast("string"), F.array_join(F.transform(other, lambda f: f["v"].cast("string")), ","))

    def field(f: Column, i: Column) -> Column:
        drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", of, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
        return F.struct(F.pmod(f["v"] + drawn, f["m"].cast("long")).cast("int").alias("v"), f["m"].alias("m"))

    return F.transform(half, field)


def permuted(fields: Column, key: str) -> Column:
    """The Feistel permutation of an array of fields (v, m); a single field is left alone with its own keyed shift."""

    def whole(f: Column) -> Column:
        half = F.floor((F.size(f) + 1) / 2).cast("int")
        start = F.struct(F.slice(f, 1, half).alias("a"), F.slice(f, half + 1, F.size(f)).alias("b"))

        def turn(s: Column, r: Column) -> Column:
            a = F.when(r % 2 == 0, _added(s["a"], s["b"], r, key)).otherwise(s["a"])
            b = F.when(r % 2 == 1, _added(s["b"], s["a"], r, key)).otherwise(s["b"])
            return F.struct(a.alias("a"), b.alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return F.when(F.size(fields) > 0, _bind(fields, whole)).otherwise(fields)


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _chars(text: Column, low: Column, high: Column, key: str, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """The text with the symbols at places ``low`` to before ``high`` permuted, each within its own alphabet."""

    def alphabet(c: Column, i: Column) -> Column:
        found = reduce(lambda rest, a: F.when(F.instr(F.lit(a), c) > 0, F.lit(a)).otherwise(rest), alphabets, F.lit(None).cast("string"))
        return F.struct(c.alias("c"), F.when((i >= low) & (i < high), found).alias("a"))

    def whole(own: Column) -> Column:
        moving = lambda x: x["a"].isNotNull()
        fields = F.transform(F.filter(own, moving), lambda x: F.struct((F.instr(x["a"], x["c"]) - 1).cast("int").alias("v"), F.length(x["a"]).alias("m")))

        def put_back(new: Column) -> Column:
            place = lambda i: F.size(F.filter(F.slice(own, F.lit(1), i), moving))
            return F.array_join(F.transform(own, lambda x, i: F.when(moving(x), F.substring(x["a"], F.get(new, place(i))["v"] + 1, F.lit(1))).otherwise(x["c"])), "")

        return _bind(permuted(fields, key), put_back)

    return _bind(F.transform(_letters(text), alphabet), whole)


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum of a card number, 0 modulo 10 for valid ones."""

    def weighted(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.reverse(_letters(digits)), weighted), F.lit(0), lambda a, x: a + x)


def _first_valid(text: Column, patterns: list[str], valid, changed) -> Column:
    """The text with its longest valid beginning changed; the patterns name the beginnings, longest first. What follows stays."""
    beginnings = F.array(*[F.regexp_extract(text, p, 0) for p in patterns])
    chosen = F.get(F.filter(beginnings, lambda t: (t != "") & valid(t)), F.lit(0))
    return F.when(chosen.isNotNull(), F.concat(_bind(chosen, changed), F.substring(text, F.length(chosen) + 1, F.length(text)))).otherwise(text)


def _card(text: Column, key: str) -> Column:
    body = lambda t: F.substring(t, F.lit(1), F.length(t) - 1)
    check = lambda t: F.pmod(10 - luhn_sum(F.concat(F.regexp_replace(body(t), "[^0-9]", ""), F.lit("0"))), F.lit(10)).cast("string")
    new = lambda t: _bind(_chars(t, F.lit(1), F.length(t) - 1, key), lambda u: F.concat(body(u), check(u)))
    patterns = [f"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?=[ -]|$)" for n in range(19, 12, -1)]
    return _first_valid(text, patterns, lambda t: luhn_sum(F.regexp_replace(t, "[^0-9]", "")) % 10 == 0, new)


def _mod97(text: Column) -> Column:
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_letters(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + digit(c)).otherwise(a * 100 + digit(c)) % 97)


def _iban(text: Column, key: str) -> Column:
    def valid(t: Column) -> Column:
        plain = F.regexp_replace(t, " ", "")
        return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1

    def checked(t: Column) -> Column:
        rest = F.substring(t, F.lit(5), F.length(t))
        number = 98 - _mod97(F.concat(F.regexp_replace(rest, " ", ""), F.substring(t, 1, 2), F.lit("00")))
        return F.concat(F.substring(t, 1, 2), F.lpad(number.cast("string"), 2, "0"), rest)

    patterns = [f"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?= |$)" for n in range(30, 10, -1)]
    return _first_valid(text, patterns, valid, lambda t: _bind(_chars(t, F.lit(4), F.length(t), key), checked))


def _date(text: Column, key: str) -> Column:
    year_first = text.rlike("^[0-9]{4}")
    iso = lambda y, m, d: F.try_to_date(F.concat_ws("-", *[F.substring(text, F.lit(p), F.lit(n)) for p, n in ((y, 4), (m, 2), (d, 2))]), "yyyy-MM-dd")
    forms = [  # when it applies, the day it means, how it is written
        (text.rlike("^[0-9]{4}-"), iso(1, 6, 9), "yyyy-MM-dd"),
        (text.rlike("^[0-9]{4}/"), iso(1, 6, 9), "yyyy/MM/dd"),
        (~year_first & text.contains("."), iso(7, 4, 1), "dd.MM.yyyy"),
        (~year_first & iso(7, 4, 1).isNotNull(), iso(7, 4, 1), "dd/MM/yyyy"),
        (~year_first, iso(7, 1, 4), "MM/dd/yyyy"),
    ]

    def moved(day: Column, form: str) -> Column:
        number = F.datediff(day, F.lit("1900-01-01").cast("date"))
        fields = F.array(F.struct(F.floor(number / DAY_RADICES[1]).cast("int").alias("v"), F.lit(DAY_RADICES[0]).alias("m")), F.struct((number % DAY_RADICES[1]).alias("v"), F.lit(DAY_RADICES[1]).alias("m")))
        back = lambda f: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.get(f, F.lit(0))["v"] * DAY_RADICES[1] + F.get(f, F.lit(1))["v"]), form)
        return F.when((number >= 0) & (number < DAYS), _bind(permuted(fields, key), back)).otherwise(text)

    return reduce(lambda rest, f: F.when(f[0], moved(f[1], f[2])).otherwise(rest), reversed(forms), text)


def _numbers(text: Column, separator: str, radices: tuple[int, ...], least: int, widths: tuple[int, ...] | None, key: str) -> Column:
    """Numbers between separators, each a field that starts at ``least``."""
    parts = F.split(text, separator)
    of = lambda i: F.get(parts, F.lit(i)).cast("int")
    fields = F.array(*[F.struct((of(i) - least).cast("int").alias("v"), F.lit(m).alias("m")) for i, m in enumerate(radices)])
    inside = reduce(lambda a, b: a & b, [(of(i) >= least) & (of(i) < least + m) for i, m in enumerate(radices)])
    show = lambda f, i: (F.get(f, F.lit(i))["v"] + least).cast("string")
    joined = lambda f: F.concat_ws(separator.strip("\\"), *[F.lpad(show(f, i), widths[i], "0") if widths else show(f, i) for i in range(len(radices))])
    return F.when(inside, _bind(permuted(fields, key), joined)).otherwise(text)


def pseudonym(text: Column, key: str) -> Column:
    """The pseudonym of one candidate; what is not valid stays."""
    end = F.length(text)
    country = F.greatest(F.length(F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])", 0)), F.when(text.startswith("+"), 2).otherwise(0))
    values = {
        "email": _chars(text, F.lit(0), F.instr(text, "@") - 1, key),
        "credential": _chars(text, F.length(F.regexp_extract(text, "^[a-z_]+[=:]", 0)), end, key),
        "access_key": _chars(text, F.lit(4), end, key),
        "hex": _chars(text, F.lit(0), end, key, (HEXADECIMAL,)),
        "iban": _iban(text, key),
        "date": _date(text, key),
        "ipv4": _numbers(text, "\\.", (256,) * 4, 0, None, key),
        "ssn": _numbers(text, "-", (899, 99, 9999), 1, (3, 2, 4), key),
        "phone": _chars(text, country, end, key),
        "card": _card(text, key),
    }
    return reduce(lambda rest, kind: F.when(text.rlike(f"^(?:{PATTERNS[kind]})$"), values[kind]).otherwise(rest), reversed(list(PATTERNS)), text)


def session_key(spark: SparkSession) -> str:
    """The key of the session, from the setting ``KEY_SETTING``; a random one for this session alone where none is set."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Documents with every valid value in ``column`` replaced by its pseudonym under ``key``, and ``n_values``, the number replaced.

    Who has the key can undo the pseudonyms, and equal values get equal ones under equal keys only, so it is a secret to be kept with the corpus.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col(column)
    found = docs.withColumn("_found", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    found = found.withColumn("_new", F.transform("_found", lambda value: pseudonym(value, key)))
    # Between n values lie n + 1 stretches of other text.
    rest = F.transform("_new", lambda v, i: F.concat(v, F.get("_rest", i + 1)))
    found = found.withColumn("_rest", F.when(F.size("_found") > 0, F.split(text, ANY, -1)))
    done = F.when(F.size("_found") > 0, F.concat(F.get("_rest", F.lit(0)), F.array_join(rest, ""))).otherwise(text)
    count = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x)).cast("int")
    return found.withColumns({column: done, "n_values": F.when(F.size("_found") > 0, count).otherwise(0)}).drop("_found", "_new", "_rest")


@query()
def op2_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymised(table(spark, folder, "documents").select("doc_id", "text"), session_key(spark))
