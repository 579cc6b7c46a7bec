"""Checks of identifiers, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Ranges of issuers and the lengths of their numbers.
ISSUERS = (
    (r"4", (13, 16, 19)), (r"5[1-5]", (16,)), (r"2(22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)", (16,)), (r"3[47]", (15,)), (r"6(011|5|4[4-9])", (16,)),
    (r"35(2[89]|[3-8]\d)", (16,)), (r"3(0[0-5]|[68])", (14,)), (r"(60|81|82|508)", (16,)),
)


def card_shape() -> str:
    """A pattern of digits that begin as an issuer's do and are as many as its numbers have."""
    return "|".join(rf"(?={first})\d{{{n}}}" for first, lengths in ISSUERS for n in lengths)


def card(number: Column) -> Column:
    """Digits of an issuer's range and one of its lengths that pass the Luhn check."""
    d = F.regexp_replace(number, "[ -]", "")
    return F.rlike(d, F.lit(rf"^({card_shape()})$")) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def imei(number: Column) -> Column:
    d = F.regexp_replace(number, "[ -]", "")
    return F.rlike(d, F.lit(r"^\d{15}$")) & F.call_function("luhn_check", d)


def iban(text: Column) -> Column:
    """Country, check digits and modulus 97, folded digit by digit."""
    plain = F.upper(F.regexp_replace(text, " ", ""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: ((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int")
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))
    return F.coalesce(F.rlike(plain, F.lit(r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$")) & (rest == 1), F.lit(False))


def ipv4(text: Column) -> Column:
    part = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.rlike(text, F.lit(rf"^{part}(\.{part}){{3}}$"))


def digest_kind(digest: Column) -> Column:
    """Algorithm of a hex digest by its length."""
    n = F.length(digest)
    kind = F.when(n == 32, "md5").when(n == 40, "sha1").when(n == 64, "sha256")
    return F.when(F.rlike(F.lower(digest), F.lit("^[0-9a-f]+$")), kind)
