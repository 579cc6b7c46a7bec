"""Entities in text: found by pattern, proven by check, overlaps resolved by span, counted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import checks


def luhn(digits: str) -> bool:
    """Sum with every second digit from the right doubled, a multiple of ten; of twelve digits at least."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return len(digits) >= 12 and (doubled + sum(map(int, digits[::-2]))) % 10 == 0


CARD = re.compile(checks.card_shape())
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdecimal() and c.isascii())


def card(text: str) -> bool:
    d = digits_of(text)
    return bool(CARD.fullmatch(d)) and luhn(d)


def imei(text: str) -> bool:
    d = digits_of(text)
    return len(d) == 15 and luhn(d)


def iban(text: str) -> bool:
    """Country, two check digits and the rest, which leave 1 of 97 with the country moved to the end."""
    plain = "".join(text.split()).upper()
    country, digits, rest = plain[:2], plain[2:4], plain[4:]
    if not (country.isalpha() and digits.isdecimal() and 10 <= len(rest) <= 30 and rest.isalnum() and plain.isascii()):
        return False
    left = 0
    for value in (int(c, 36) for c in rest + country + digits):
        left = (left * (100 if value > 9 else 10) + value) % 97
    return left == 1


def phone(text: str) -> bool:
    d = digits_of(text)
    return 7 <= len(d) <= 15 and len(set(d)) > 2


#: Endings that tell an e-mail address from a payment address.
ENDINGS = (".com", ".net", ".org", ".in", ".co", ".io", ".gov", ".edu", ".uk", ".me", ".info", ".biz", ".ru", ".cn", ".de", ".fr")


def upi(text: str) -> bool:
    return not text.lower().endswith(ENDINGS)


def btc(text: str) -> bool:
    """The checksum of a base-58 or bech32 address."""
    if text.lower().startswith(("bc1", "tb1")):
        return bech32(text.lower())
    if any(c not in BASE58 for c in text):
        return False
    number = 0
    for c in text:
        number = number * 58 + BASE58.index(c)
    if number.bit_length() > 200 or len(text) - len(text.lstrip("1")) != 25 - (number.bit_length() + 7) // 8:
        return False
    raw = number.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def bech32(text: str) -> bool:
    head, _, data = text.rpartition("1")
    if not head or len(data) < 6 or len(text) > 90 or any(c not in BECH32 for c in data):
        return False
    state = 1
    for value in [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [BECH32.index(c) for c in data]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ value
        for k, generator in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            state ^= generator * (top >> k & 1)
    return state in (1, 0x2BC830A3)


@dataclass(frozen=True)
class Kind:
    """A pattern, the weight of the kind, a check on what it finds, and the normal form; lower case if none is given."""

    name: str
    pattern: str
    weight: float
    check: Callable[[str], bool] | None = None
    normal: Callable[[str], str] | None = None


#: Addresses of schemas and the like, which are no leads.
STOP = re.compile(r"(schemas\.|w3\.org|apple\.com/DTDs|android\.com|googleapis\.com/auth|\.xsd|purl\.org|ns\.adobe\.com)", re.IGNORECASE)
#: Kinds that may hold other entities and claim no span.
OPEN = ("url", "onion", "email")
#: Kinds with their patterns and weights.
KINDS = (
    Kind("phone", r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,5}[\s.-]?\d{3,4}[\s.-]?\d{0,4}(?![\w.])", 0.7, phone, lambda x: digits_of(x)[-10:]),
    Kind("email", r"[\w.+-]+@[\w-]+\.[\w.-]{2,}", 0.6),
    Kind("url", r"(?i:https?://[^\s<>\"')]+|www\.[^\s<>\"')]+)", 0.4, lambda x: not STOP.search(x)),
    Kind("onion", r"(?i:\b[a-z2-7]{16}\.onion\b|\b[a-z2-7]{56}\.onion\b)", 1.0),
    Kind("btc", r"\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{25,62})\b", 1.0, btc),
    Kind("eth", r"\b0x[a-fA-F0-9]{40}\b", 0.95),
    Kind("xmr", r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b", 1.0),
    Kind("iban", r"\b[A-Z]{2}\d{2}\s?(?:[A-Z0-9]{4}\s?){2,7}[A-Z0-9]{1,4}\b", 0.9, iban),
    Kind("card", r"\b(?:\d{4}[\s-]?){3}\d{1,7}\b|\b\d{13,19}\b", 0.9, card, digits_of),
    Kind("upi", r"\b[a-zA-Z0-9._-]{3,64}@[a-zA-Z]{2,20}\b", 0.75, upi),
    Kind("imei", r"\b\d{15}\b", 0.85, imei),
    Kind("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.5),
    Kind("coords", r"[-+]?\d{1,2}\.\d{4,},\s?[-+]?\d{1,3}\.\d{4,}", 0.8),
    Kind("vehicle_in", r"\b[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{1,3}[\s-]?\d{4}\b", 0.7, None, lambda x: re.sub(r"[\s-]", "", x.upper())),
    Kind("tracking", r"\b(?:1Z[0-9A-Z]{16}|[A-Z]{2}\d{9}[A-Z]{2})\b", 0.7),
    Kind("handle", r"(?<![\w@])@[A-Za-z][\w.]{2,29}\b", 0.5),
)
#: Attributes that are read like a body.
ATTRIBUTES = ("url", "search_terms", "title", "note", "subject", "media_caption", "term", "target_path", "referrer")


def in_text(text: str, kinds: tuple[tuple[Kind, re.Pattern], ...]) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of a text's entities: the weightiest and then longest claims its span, others on it go."""
    found = []
    for k, pattern in kinds:
        for m in pattern.finditer(text):
            raw = m[0].strip()
            if raw and (k.check is None or k.check(raw)):
                value = k.normal(raw) if k.normal else raw.lower()
                if value:
                    found.append((-k.weight, m.start() - m.end(), k.name, value, m.start(), m.end()))
    found.sort(key=lambda x: x[:2])
    taken: list[tuple[int, int]] = []
    kept = []
    for _, _, name, value, start, end in found:
        if name not in OPEN:
            if any(start < b and end > a for a, b in taken):
                continue
            taken.append((start, end))
        kept.append((name, value, start, end))
    return kept


def mentions(df: DataFrame, id_column: str, text_column: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, kind, value, start, end) for each mention in whole texts; null texts have none. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tuple((k, re.compile(k.pattern)) for k in kinds)
        for b in batches:
            rows, which = [], []
            for k, text in enumerate(b.column(1)):
                found = in_text(text.as_py() or "", compiled)
                rows += found
                which += [k] * len(found)
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *columns], [id_column, "kind", "value", "start", "end"])

    given = df.select(id_column, text_column)
    fields = [StructField("kind", StringType()), StructField("value", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]
    return given.mapInArrow(run, StructType([given.schema[0], *fields]))


def texts_of(df: DataFrame) -> DataFrame:
    """(artifact_id, text): bodies and the attributes that are read like them, a row for each that isn't empty."""
    parts = F.array(F.col("body"), *(F.get_json_object("attributes", f"$.{a}") for a in ATTRIBUTES))
    return df.select("artifact_id", F.explode(parts).alias("text")).filter(F.length("text") >= 3)


def aggregate(
    found: DataFrame, id_column: str, kinds: tuple[Kind, ...] = KINDS, owners: DataFrame | None = None, contacts: DataFrame | None = None
) -> DataFrame:
    """Entities with their mentions, rows and significance, weight * (1 + ln(1 + n)).

    owners and contacts (value): phones of the holder are left out; those in no address book weigh 0.15 more, 1 at
    most, if contacts are given.
    """
    if owners is not None:
        own = owners.select("value", F.lit("phone").alias("kind")).distinct()
        found = found.join(own, ["kind", "value"], "left_anti")
    weight = F.create_map(*(F.lit(x) for k in kinds for x in (k.name, k.weight)))[F.col("kind")]
    each = found.groupBy("kind", "value", id_column).agg(F.count(F.lit(1)).alias("n"))
    out = each.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    if contacts is not None:
        known = contacts.select("value").distinct().withColumn("_known", F.lit(True))
        out = out.join(known, "value", "left")
        weight = F.when((F.col("kind") == "phone") & F.col("_known").isNull(), F.least(F.lit(1.0), weight + 0.15)).otherwise(weight)
    return out.select("kind", "value", "n", "rows", F.round(weight * (1 + F.log1p(F.col("n"))), 6).alias("significance"))
