"""Identity keys of parties. Three rules differ on purpose and must not be mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Messaging domains whose numeric local part is a phone number.
NUMBER_DOMAINS = ("s.whatsapp.net", "c.us")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def last_digits(c: Column, n: int = 10) -> Column:
    return F.right(digits(c), F.lit(n))


def _number_or_lower(c: Column) -> Column:
    return F.when(F.length(digits(c)) >= 7, last_digits(c)).otherwise(F.lower(F.trim(c)))


def party_key(identifier: Column, name: Column | None = None) -> Column:
    """Key of stored parties: a blank identifier falls back to the name, an address keeps its domain."""
    ident = F.trim(F.coalesce(identifier, F.lit("")))
    other = F.lower(F.trim(F.coalesce(name, F.lit("")))) if name is not None else F.lit("")
    address = F.lower(F.substring_index(ident, "/", 1))
    return F.when(ident == "", other).when(F.contains(ident, F.lit("@")), address).otherwise(_number_or_lower(ident))


def correlation_key(identifier: Column) -> Column:
    """Key across exhibits: the messaging domain goes first, so a number and its account agree."""
    ident = F.trim(F.coalesce(identifier, F.lit("")))
    plain = F.regexp_replace(ident, "@(" + "|".join(d.replace(".", r"\.") for d in NUMBER_DOMAINS) + ")$", "")
    return F.when(F.contains(plain, F.lit("@")), F.lower(plain)).otherwise(_number_or_lower(plain))


def graph_key(identifier: Column, is_owner: Column) -> Column:
    """Key of graph nodes: the owner is one node, accounts on number domains become numbers."""
    ident = F.trim(F.coalesce(identifier, F.lit("")))
    local = F.substring_index(ident, "@", 1)
    account = F.substring_index(F.lower(ident), "@", -1).isin(*NUMBER_DOMAINS) & F.rlike(local, F.lit("^[0-9]+$"))
    return (
        F.when(is_owner, F.lit("__owner__"))
        .when(account, F.right(local, F.lit(10)))
        .otherwise(party_key(identifier))
    )


def same_owner(a: Column, b: Column) -> Column:
    """Owner test of decoding: the last nine digits, or the same text without case."""
    return ((F.length(digits(a)) >= 9) & (last_digits(a, 9) == last_digits(b, 9))) | (F.lower(a) == F.lower(b))
