"""Personal data: format-preserving Feistel pseudonyms, in SQL functions only.

Numbers and dates that pass validation are permuted within their format by a keyed Feistel
network, so equal values get equal pseudonyms in all documents and different values different ones:

* payment cards (13 to 19 unbroken digits, groups of four, 4-6-4, 4-6-5 or 8-8, that pass the Luhn test): all
  digits but the last are permuted, the last is the new check digit; spaces and hyphens stay.  In a longer run of
  groups of four, each four that pass are a number.
* phone numbers, social security numbers: the digits (after a country code) are permuted.  A number ends where its
  country's length ends; for codes not in ``LENGTHS``, before an address, date or card, or after five groups.
* IPv4 addresses with octets up to 255: the 32 bits are permuted.
* dates from 1900 to 2099 (ISO, or day and month with a four-digit year; month first where day first is no date): the
  day number is permuted.

Names of mailboxes and secrets (access keys, passwords, tokens) have no format worth keeping: they
become keyed digests, again equal for equal values.

A network alternates between two parts with moduli a and b: (x, y) -> (y, x + F(y) mod a), where F is
a keyed SHA-256; over an even number of rounds this permutes all a * b values.

Texts without any of ``HINT`` (a digit, ``@``, a secret's word or a key's prefix) skip the search.  Null stays null and empty stays empty; repeated values,
rows and documents change alike.  What fails validation is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import free

KEY_SETTING = "spark.contrapunto.pseudonym.key"
ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}"
KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
ISO = r"(?<![\d-])(?:19|20)\d{2}-\d{2}-\d{2}(?![\d-])"
DMY = r"(?<![\d/.])\d{1,2}([/.])\d{1,2}\1(?:19|20)\d{2}(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Unbroken digits; groups of four, perhaps several numbers in a row; 4-6-4 and 4-6-5; two halves.
CARD = (r"(?<![\d+])(?:\d{13,19}(?!\d)|\d{4}(?:[ -]\d{4}){3}(?!\d)(?:[ -]\d{4}(?!\d|[/.-]\d{1,3}(?!\d)))*(?:[ -]\d{3}(?!\d|[/.-]\d))?"
        r"|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)|\d{8}[ -]\d{8}(?!\d))")
#: Digits after the country code, where a country has one length or two.
LENGTHS = [(11, "55|86"), (10, "7|44|52|54|55|57|90|91|92"), (9, "27|31|32|33|34|41|48|51|56|61|351|380")]
#: The digits of a phone number do not go on into another kind of value.
_OTHER = (r"(?!\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|(?:19|20)\d{2}-\d{2}-\d{2}(?!\d)|\d{1,2}[/.]\d{1,2}[/.](?:19|20)\d{2}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)|\d{13,19}(?!\d))")
PHONE = "|".join([r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
                  *[rf"(?<![\w+])\+(?:{codes})[ .-]?(?:\(0\))?(?:[ .()-]{{0,2}}{_OTHER}\d){{{n}}}(?!\d)" for n, codes in LENGTHS],
                  rf"(?<![\w+])\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:[ .-]?{_OTHER}\d{{2,4}}){{2,4}}(?!\d)",
                  r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)", r"(?<![\d.-])\d{3}([.-])\d{3}\2\d{4}(?!\d)"])
ANY = "|".join([EMAIL, SECRET, KEY, HEX, IP, ISO, DMY, SSN, CARD, PHONE])
#: What every match of ``ANY`` holds some of; cheap to look for.
HINT = r"[0-9@]|(?i:password|passwd|secret|token|api_?key)|AKIA|ASIA|gh[pousr]_|sk-|[a-f]{32}|[A-F]{32}"
#: What each kind looks like once it is found.
SHAPES = {"email": r"^[^\s=:]+@", "secret": r"^(?i:password|passwd|secret|token|api)", "key": r"^(?:AKIA|ASIA|gh[pousr]_|sk-|[0-9a-f]{32}|[0-9A-F]{32})",
          "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$", "iso": r"^\d{4}-\d{2}-\d{2}$", "dmy": r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}$",
          "ssn": r"^\d{3}-\d{2}-\d{4}$", "phone": r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"}
WALK = 64  # about 0.39 of all days are up to the 12th: the walk is longer once in 10**26
DAYS, FIRST_DAY = 73049, "1900-01-01"  # to 2099-12-31; 73049 = 319 * 229


def _number(text: Column) -> Column:
    """60 bits of a keyed digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _digest(key: str, kind: str, value: Column, width: int) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), value), 256), 1, width)


def feistel(key: str, kind: str, x: Column, y: Column, a: Column, b: Column) -> Column:
    """struct(x, y) of the permuted pair; x is below a and y below b."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    def round_(s: Column, r: Column) -> Column:
        f = _number(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), s["a"].cast("string"), s["b"].cast("string"), s["y"].cast("string")))
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + f, s["a"]).cast("long").alias("y"), s["b"].alias("a"), s["a"].alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def _permuted(key: str, kind: str, digits: Column) -> Column:
    """A digit string of the same length (up to 18)."""
    h = F.floor(F.length(digits) / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), h), F.substring(digits, h + 1, F.length(digits) - h)
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    state = feistel(key, kind, left.cast("long"), right.cast("long"), ten(h), ten(F.length(digits) - h))
    # one-element transform: names the pair, so that the network is evaluated once
    return F.element_at(F.transform(F.array(state), lambda s: F.concat(F.lpad(s["x"].cast("string"), h, "0"), F.lpad(s["y"].cast("string"), F.length(digits) - h, "0"))), 1)


def _sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum; ``double_last`` when the check digit is not part of the digits."""
    n = F.length(digits)
    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == (0 if double_last else 1)
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, v: s + v)


def luhn(digits: Column) -> Column:
    return F.pmod(_sum(digits, False), F.lit(10)) == 0


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    def put(s: Column, c: Column) -> Column:
        isd = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(isd, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(isd, s["at"] + 1).otherwise(s["at"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, put, lambda s: s["out"])


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _card(key: str, m: Column) -> Column:
    """All digits if they are one number, else each four groups of four that are one, from the left."""
    def fresh(d: Column) -> Column:
        body = _permuted(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        return _named(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_sum(b, True), F.lit(10)), F.lit(10)).cast("string")))
    def step(s: Column, g: Column) -> Column:
        def taken(d: Column) -> Column:
            last = F.substring(d, -16, 16)
            new = F.struct(F.concat(s["done"], F.substring(d, F.lit(1), F.length(d) - 16), fresh(last)).alias("done"), F.lit("").alias("open"))
            return F.when((F.length(d) >= 16) & (F.length(g) == 4) & luhn(last), new).otherwise(F.struct(s["done"].alias("done"), d.alias("open")))
        return _named(F.concat(s["open"], g), taken)
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    parts = F.aggregate(F.split(m, "[ -]"), start, step, lambda s: F.concat(s["done"], s["open"]))
    whole = lambda d: F.when((F.length(d) <= 19) & luhn(d), fresh(d)).otherwise(parts)
    return _filled(m, _named(F.regexp_replace(m, "[^0-9]", ""), whole))


def _digits(key: str, kind: str, m: Column) -> Column:
    """All digits permuted, but for a country code after a plus."""
    def fresh(code: Column) -> Column:
        rest = F.substring(m, F.length(code) + 1, F.length(m))
        return F.concat(code, _named(F.regexp_replace(rest, "[^0-9]", ""), lambda d: _filled(rest, _permuted(key, kind, d))))
    return _named(F.regexp_extract(m, r"^\+\d{1,3}(?=\D)", 0), fresh)


def _ip(key: str, m: Column) -> Column:
    def fresh(o: Column) -> Column:
        octet = lambda i: F.element_at(o, i).cast("long")
        state = feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536))
        byte = lambda v, s: F.pmod(F.floor(v / s), F.lit(256)).cast("string")
        new = _named(state, lambda s: F.concat_ws(".", byte(s["x"], 256), byte(s["x"], 1), byte(s["y"], 256), byte(s["y"], 1)))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), new).otherwise(m)
    return _named(F.split(m, r"\."), fresh)


def _day(key: str, day: Column) -> Column:
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    state = feistel(key, "day", F.floor(n / 229), F.pmod(n, F.lit(229)), F.lit(319), F.lit(229))
    return _named(state, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["x"] * 229 + s["y"]).cast("int")))


def _dated(key: str, m: Column) -> Column:
    iso = F.try_to_date(m, "yyyy-MM-dd")
    return F.when(iso.isNotNull(), F.date_format(_day(key, iso), "yyyy-MM-dd")).otherwise(m)


def _written(key: str, m: Column) -> Column:
    """Day first; month first where only that is a date, which stays one by repeating the permutation."""
    sep = F.regexp_extract(m, "[/.]", 0)
    plain = F.regexp_replace(m, r"\.", "/")
    day, month = F.try_to_date(plain, "d/M/yyyy"), F.try_to_date(plain, "M/d/yyyy")
    again = lambda d, i: F.when((i > 1) & (F.dayofmonth(d) > 12), d).otherwise(_day(key, d))
    after = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), month, again)
    new = F.when(day.isNotNull(), F.date_format(_day(key, day), "dd/MM/yyyy")).when(month.isNotNull(), F.date_format(after, "MM/dd/yyyy"))
    return F.coalesce(F.regexp_replace(new, "/", sep), m)


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one match of ``ANY``."""
    is_ = lambda kind: m.rlike(SHAPES[kind])
    lead = F.regexp_extract(m, r"^.{1,16}?[=:]\s*[\"']?", 0)
    return (F.when(is_("email"), F.concat(F.lit("u"), _digest(key, "email", F.lower(m), 16), F.lit("@mail.invalid")))
            .when(is_("secret"), F.concat(lead, F.lit("s"), _digest(key, "secret", F.substring(m, F.length(lead) + 1, F.length(m)), 16)))
            .when(is_("key"), F.concat(F.lit("k"), _digest(key, "key", m, 16)))
            .when(is_("ip"), _ip(key, m)).when(is_("iso"), _dated(key, m)).when(is_("dmy"), _written(key, m))
            .when(is_("ssn"), _digits(key, "ssn", m)).when(is_("phone"), _digits(key, "phone", m))
            .otherwise(_card(key, m)))


def pseudonymised(docs: DataFrame, key: str | None = None, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``count`` names a column for the number of values changed.

    Without ``key`` the session's ``KEY_SETTING`` is used.  Whoever knows the key can undo the permutations,
    so a run on real data must set one; the default only serves to link equal values in trials.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, "contrapunto")
    own, one, two = F.col(f"`{text}`"), free("found", docs.columns), free("fresh", docs.columns)
    found = F.when(own.rlike(HINT), F.regexp_extract_all(own, F.lit(ANY), F.lit(0)))
    staged = docs.withColumn(one, found)
    staged = staged.withColumn(two, F.when(F.size(one) > 0, F.transform(one, lambda m: pseudonym(m, key))))
    joined = F.array_join(F.zip_with(F.split(own, ANY, -1), F.col(two), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    if count:
        staged = staged.withColumn(count, F.coalesce(F.size(F.filter(F.zip_with(one, two, lambda a, b: a != b), lambda z: z)), F.lit(0)))
    return staged.withColumn(text, F.when(F.size(one) > 0, joined).otherwise(own)).drop(one, two)
