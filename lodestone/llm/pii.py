"""Format-preserving pseudonyms by keyed Feistel permutations [DataFrame functions only].

Values are found by pattern, validated, and permuted within their own format under a secret key:

* card numbers of 13 to 19 digits that pass the Luhn test: the digits between the first and the check
  digit are permuted and the check digit is made anew, so the result passes the test too;
* IBANs whose remainder by 97 is 1: the account part is permuted, the check digits made anew;
* dates that exist, from 1900-01-01 to 2100-05-01 (271 x 270 days; ISO and day.month.year): the day
  number is permuted within that range;
* IPv4 addresses: the two 16-bit halves are permuted; phone and social-security numbers: the digits;
* e-mail addresses but for the last label, and the values of keys and passwords: every letter by a
  letter of its case, every digit by a digit.

A permutation has no collisions: equal values get equal pseudonyms in every document, different ones
of a format stay different. Numbers that fail their test are left as they are.

Card and account numbers are looked for in a second pass, in whole runs of digits (or of capitals and digits), at every
place in them where a number may begin and end: what stands before or behind a number does not hide it. Runs are taken
up to 400 characters long; a number that lies across the end of a longer run is not found.

The key is the caller's: who holds it can trace the permutation back, so it belongs in no source file. A null text stays null
with no findings, an empty text stays empty. Long texts are cut at the matches only. Repeated rows are treated alike, an empty
table gives no rows; other columns pass through whatever they are called, except that n_found and n_changed replace
columns of these names if they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import clean_name

ROUNDS = 8
DAYS_A, DAYS_B = 271, 270

_LOCAL = r"A-Za-z0-9._%+\-"
EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){{0,125}}\.[A-Za-z]{{2,}}"
_NAME = r"(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]"
SECRET = rf"""(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}(?![0-9A-Za-z])|{_NAME}\s{{0,3}}["']?[^\s"']{{5,}}[^\s"'.,;:!?)\]])"""
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)"
SSN = r"(?<![\w\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-])"
DATE = r"(?<![\w\-.])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})(?![\w\-])"
CARD = r"(?<![\w\-])\d(?:[ \-]?\d){12,399}(?![\w\-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,396}(?!\w)"
#: How a card number is written within a longer run.
LAYOUT = r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{4,5})$"
#: Two passes, each with what a text must have in it to have any of these values. In this order: an earlier kind wins where two
#: match at one place.
PASSES = [
    ([("email", EMAIL), ("secret", SECRET), ("ip", IP), ("ssn", SSN), ("date", DATE), ("phone", PHONE)], rf"[0-9@]|AKIA|{_NAME}"),
    ([("card", CARD), ("iban", IBAN)], r"\d(?:[ \-]?\d){12}|[A-Z]{2}\d{2}"),
]


def _hash_int(text: Column, modulus: Column | int) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % modulus


def _feistel(left: Column, right: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Alternating Feistel network: each round moves one half by a keyed function of the other. A struct l, r.
    The rounds are folded, since nested columns would double with each."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.alias("l"), right.alias("r")),
        lambda acc, i: F.when(i % 2 == 1, F.struct(step(acc["l"], acc["r"], i).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), step(acc["r"], acc["l"], i).alias("r"))),
    )


def _tag(key: str, kind: str, i: Column, other: Column) -> Column:
    return F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), other.cast("string"))


def _shifted(half: Column, pad: Column) -> Column:
    """Every letter or digit of ``half`` moved within its class by the pad (64 hexadecimal digits, read in pairs)."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(pad, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        within = lambda low, n: F.chr(((code - low + by) % n + low).cast("long"))
        return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permute_text(value: Column, key: str, kind: str) -> Column:
    """Every letter by one of its case, every digit by a digit, all else in place; a permutation for each shape."""
    n = F.length(value)
    half = F.floor((n + 1) / 2).cast("int")
    shape = F.translate(F.lower(value), "0123456789abcdefghijklmnopqrstuvwxyz", "0" * 10 + "a" * 26)
    both = _feistel(F.substr(value, F.lit(1), half), F.substr(value, half + 1, n), lambda a, b, i: _shifted(a, F.sha2(F.concat(_tag(key, kind, i, b), F.lit("|"), shape), 256)))
    return F.concat(both["l"], both["r"])


def permute_digits(value: Column, key: str, kind: str) -> Column:
    """The digits permuted as a string of digits, separators in place. The rest of the value is kept."""
    digits = F.split(permute_text(F.regexp_replace(value, r"\D", ""), key, kind), "")
    chars = F.split(value, "")
    # Each character with the number of digits up to it: the pieces between digits are rebuilt by position.
    placed = F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.element_at(digits, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x.rlike(r"\d"))))).otherwise(c))
    return F.array_join(placed, "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that stand before a check digit: the last one is doubled."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, b: a + b)


def luhn_check(digits: Column) -> Column:
    return ((10 - luhn_sum(digits) % 10) % 10).cast("string")


def _fit(value: Column, digits: Column) -> Column:
    """``digits`` put in the place of the letters and digits of ``value``."""
    chars, new = F.split(value, ""), F.split(digits, "")
    placed = F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.element_at(new, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x.rlike("[A-Za-z0-9]"))))).otherwise(c))
    return F.array_join(placed, "")


def _each_valid(value: Column, begin: str, least: int, most: int, valid: Callable[[Column], Column], new: Callable[[Column], Column]) -> Column:
    """``value`` with the numbers in it replaced: from the left, at each place where one may begin (after a separator, as ``begin``
    says), the longest part that ends before a separator and passes the test."""
    n = F.length(value)
    part = lambda i, j: F.substr(value, i, j - i + 1)
    ends = lambda e: F.substr(value, e, F.lit(2)).rlike("^[A-Z0-9](?:[ -]|$)")

    def step(acc: Column, s: Column) -> Column:
        may = (s > acc["done"]) & ((s == 1) | F.substr(value, s - 1, F.lit(1)).rlike("[ -]")) & F.substr(value, s, F.lit(4)).rlike(begin) & (s + least - 1 <= n)
        tries = F.sequence(F.least(n, s + most - 1), s + least - 1, F.lit(-1))
        end = F.when(may, F.get(F.filter(tries, lambda e: F.when(ends(e), valid(part(s, e))).otherwise(False)), F.lit(0)))
        found = lambda e: F.struct(F.concat(acc["out"], part(acc["done"] + 1, s - 1), new(part(s, e))).alias("out"), e.alias("done"))
        return F.get(F.transform(F.array(end), lambda e: F.when(e.isNull(), acc).otherwise(found(e))), F.lit(0))

    out = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit("").alias("out"), F.lit(0).alias("done")), step)
    return F.concat(out["out"], F.substr(value, out["done"] + 1, n))


def _is_card(value: Column) -> Column:
    d = F.regexp_replace(value, r"\D", "")
    n = F.length(d)
    return n.between(13, 19) & (luhn_check(F.substr(d, F.lit(1), n - 1)) == F.substr(d, n, F.lit(1)))


def permute_card(value: Column, key: str) -> Column:
    new = lambda v: _new_card(v, key)
    within = lambda v: F.when(v.rlike(LAYOUT), _is_card(v)).otherwise(False)
    return F.when(_is_card(value), new(value)).otherwise(_each_valid(value, r"^\d", 13, 23, within, new))


def _new_card(value: Column, key: str) -> Column:
    d = F.regexp_replace(value, r"\D", "")
    n = F.length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(F.substr(d, F.lit(2), n - 2), key, "card"))
    return _fit(value, F.concat(body, luhn_check(body)))


def _mod97(chars: Column) -> Column:
    """Remainder by 97 of the number in which A is 10 and Z is 35."""
    return F.aggregate(F.split(chars, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _is_iban(value: Column) -> Column:
    v = F.regexp_replace(value, " ", "")
    return F.length(v).between(15, 34) & (_mod97(F.concat(F.substr(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1)


def permute_iban(value: Column, key: str) -> Column:
    new = lambda v: _new_iban(v, key)
    return F.when(_is_iban(value), new(value)).otherwise(_each_valid(value, r"^[A-Z]{2}\d{2}$", 15, 42, _is_iban, new))


def _new_iban(value: Column, key: str) -> Column:
    v = F.regexp_replace(value, " ", "")
    country, account = F.substring(v, 1, 2), F.substr(v, F.lit(5), F.length(v))
    new = permute_text(account, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return _fit(value, F.concat(country, check, new))


def permute_date(value: Column, key: str) -> Column:
    def one(fmt: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(fmt))), F.lit("1900-01-01").cast("date"))
        both = _feistel(
            F.expr("0L") + F.floor(day / DAYS_B).cast("long"), (day % DAYS_B).cast("long"),
            lambda a, b, i: (a + _hash_int(_tag(key, "date", i, b), F.when(i % 2 == 1, DAYS_A).otherwise(DAYS_B))) % F.when(i % 2 == 1, DAYS_A).otherwise(DAYS_B),
        )
        new = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (both["l"] * DAYS_B + both["r"]).cast("int")), fmt)
        return F.when(day.between(0, DAYS_A * DAYS_B - 1), new).otherwise(value)

    return F.when(value.contains("."), one("dd.MM.yyyy")).otherwise(one("yyyy-MM-dd"))


def permute_ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    both = _feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], lambda a, b, i: (a + _hash_int(_tag(key, "ip", i, b), 65536)) % 65536)
    return F.concat_ws(".", *[x.cast("long").cast("string") for h in ("l", "r") for x in (F.floor(both[h] / 256), both[h] % 256)])


def permute_email(value: Column, key: str) -> Column:
    cut = F.length(value) - F.length(F.substring_index(value, ".", -1))
    return F.concat(permute_text(F.substr(value, F.lit(1), cut), key, "email"), F.substr(value, cut + 1, F.length(value)))


def permute_phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}[ .\-]?(?=\(|\d{3}[ .\-])", 0)
    return F.concat(country, permute_digits(F.substr(value, F.length(country) + 1, F.length(value)), key, "phone"))


def permute_secret(value: Column, key: str) -> Column:
    name = F.regexp_extract(value, rf"""^(?:AKIA(?=[0-9A-Z]{{16}}$)|{_NAME}\s{{0,3}}["']?)""", 0)
    return F.concat(name, permute_text(F.substr(value, F.length(name) + 1, F.length(value)), key, "secret"))


PERMUTE = {"email": permute_email, "secret": permute_secret, "ip": permute_ip, "ssn": lambda v, k: permute_digits(v, k, "ssn"), "date": permute_date, "phone": permute_phone, "card": permute_card, "iban": permute_iban}


def permuted(value: Column, kinds: list[tuple[str, str]], key: str) -> Column:
    """One match, as its kind is permuted."""
    out = value
    for kind, pattern in reversed(kinds):
        # Alone, a match stands without its neighbours, which the look-arounds accept.
        out = F.when(value.rlike(f"^(?:{pattern})$"), PERMUTE[kind](value, key)).otherwise(out)
    return out


def _permuter(kinds: list[tuple[str, str]], key: str) -> Callable[[Column], Column]:
    return lambda match: permuted(match, kinds, key)


def pseudonymise(docs: DataFrame, key: str, column: str = "text", report: bool = True) -> DataFrame:
    """The documents with every value in ``column`` replaced; with ``report`` also n_found (matches) and
    n_changed (those in which there was a valid value)."""
    d = docs.select(F.struct("*").alias("row"), F.col(f"`{column}`").alias("text"), F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_changed"))
    for kinds, hint in PASSES:
        pattern = "|".join(p for _, p in kinds)
        found = F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        d = d.withColumn("found", found)
        some = F.coalesce(F.size("found") > 0, F.lit(False))
        d = d.withColumn("new", F.when(some, F.transform("found", _permuter(kinds, key))))
        woven = F.array_join(F.zip_with(F.split("text", pattern, -1), F.col("new"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
        counts = {"n_found": F.col("n_found") + F.when(some, F.size("found")).otherwise(0), "n_changed": F.col("n_changed") + F.when(some, changed).otherwise(0)} if report else {}
        d = d.withColumns({"text": F.when(some, woven).otherwise(F.col("text"))} | counts).drop("found", "new")
    added = ["n_found", "n_changed"] if report else []
    return d.select(*[F.col("text").alias(c) if c == column else F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def query(docs: DataFrame, key: str) -> DataFrame:
    return pseudonymise(clean_name(docs, "doc_id", "text"), key)
