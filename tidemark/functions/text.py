"""Text tokens for search: lower case, accents folded."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters with diacritics of the Latin, Greek and Cyrillic blocks and the letters without, then the marks themselves, to be dropped."""
    marked, plain = [], []
    for block in (range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000)):
        for c in map(chr, block):
            base, *rest = unicodedata.normalize("NFD", c)
            if rest and all(unicodedata.combining(x) for x in rest):
                marked.append(c)
                plain.append(base)
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


ACCENTED, PLAIN = _plain_letters()


def fold(c: Column) -> Column:
    """Lower case without diacritics, composed or apart."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.array_remove(F.split(fold(c), r"[^\p{L}\p{N}]+"), "")


def summary(body: Column, *others: Column, width: int = 120) -> Column:
    """One line of a body, cut with an ellipsis; of the others if it is blank."""
    line = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))
    first = F.coalesce(*(F.nullif(line(c), F.lit("")) for c in (body, *others)), F.lit(""))
    return F.when(F.length(first) > width, F.concat(F.substring(first, 1, width - 1), F.lit("…"))).otherwise(first)


def clean_number(c: Column) -> Column:
    """Digits of a number with a leading plus if it has one; blank if it has no digit."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    plus = F.when(F.startswith(F.trim(c), F.lit("+")) & (digits != ""), "+").otherwise("")
    return F.concat(plus, digits)


def context(c: Column, term: str, around: int = 60) -> Column:
    """The first place of a term, without case, with so many characters on either side, dots where it is cut; null without it."""
    at = F.locate(term.lower(), F.lower(c))
    begin, stop = F.greatest(at - around, F.lit(1)), F.least(at + len(term) + around, F.length(c) + 1)
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(c, begin, stop - begin), F.when(stop <= F.length(c), "…").otherwise(""))
    return F.when(at > 0, cut)


def hex_dump(c: Column, most: int = 64) -> Column:
    """Bytes in pairs of hex digits, spaces between; the first so many."""
    return F.trim(F.regexp_replace(F.lower(F.hex(F.substring(c.cast("binary"), 1, most))), "(..)", "$1 "))
