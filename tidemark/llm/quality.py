"""Quality rules, line first: judge each line, remove the failing ones, reject documents that lose too much."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, names_apart, table, words_of

SYMBOLS = r"[#*$%&|<>]"

#: Fixed phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "terms of service",
    "terms of use",
    "sign up for our newsletter",
    "skip to content",
    "click here to",
    "follow us on",
    "share this article",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    symbols_per_word: symbol characters a word from which a line is noise.
    shouts_per_word: doubled exclamation marks a word from which a line is noise.
    menu_separators, menu_share: a line with that many separators between words, and that share
    of its words separators, is a menu.
    short_words: a line of fewer words without a closing mark is a menu entry,
    unspaced: unless it has that many characters of scripts that put no spaces between words.
    max_lost: share of a document's word characters whose loss rejects it.
    min_words, max_repeat_percent: the base rules.
    window: words in a repeated window.
    """

    symbols_per_word: float = 0.5
    shouts_per_word: float = 0.5
    menu_separators: int = 3
    menu_share: float = 0.2
    short_words: int = 3
    unspaced: int = 8
    max_lost: float = 0.3
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    boilerplate: tuple[str, ...] = BOILERPLATE


#: Marks that end a sentence or a clause.
CLOSING = ".!?:;,…\"'”’»)]。！？"
#: Characters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}]"
#: Characters whose count decides the punctuation and menu rules.
SUSPECT = r"[#*$%&<>|»·•/!]"


def short_failure(line: Column, rules: LineRules) -> Column:
    """A line of few words without a closing mark is a menu entry. Spaces count no words where a script has none."""
    short = rf"^[\x20\x09-\x0D]*{WORD}([\x20\x09-\x0D]+{WORD}){{0,{rules.short_words - 2}}}[\x20\x09-\x0D]*$"
    last = F.substring(F.btrim(line, F.lit(SPACE_CHARS)), -1, 1)
    entry = F.rlike(line, F.lit(short)) & ~last.isin(*CLOSING) & (F.regexp_count(line, F.lit(UNSPACED)) < rules.unspaced)
    return F.when(entry, F.lit("navigation"))


def line_failure(line: Column, rules: LineRules) -> Column:
    """Name of the first rule the line fails, or null. Lines without a word fail none."""
    n = F.regexp_count(line, F.lit(WORD))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&<>]"))
    shouts = F.regexp_count(line, F.lit("!!+"))
    bars = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])[|>»·•/](?![^\x20\x09-\x0D])"))
    marks = (
        F.when((symbols >= 3) & (symbols >= n * rules.symbols_per_word), F.lit("punctuation"))
        .when((shouts >= 3) & (shouts >= n * rules.shouts_per_word), F.lit("punctuation"))
        .when((bars >= rules.menu_separators) & (bars >= n * rules.menu_share), F.lit("navigation"))
    )
    return F.coalesce(
        F.when(F.regexp_count(line, F.lit(SUSPECT)) >= 3, marks),
        short_failure(line, rules),
        F.when((n <= 40) & F.rlike(F.lower(line), F.lit("|".join(rules.boilerplate))), F.lit("boilerplate")),
    )


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the array, counted once each."""
    n = F.size(words)
    hashes = F.when(
        n > window,
        F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(words[i + k] for k in range(window)))),
    )
    return hashes


def covered(hashes: Column, window: int) -> Column:
    """Positions covered by the windows whose hash occurs more than once."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    at = F.sequence(F.lit(0), F.size(hashes) - 1)

    def count(ordered: Column) -> Column:
        twice = F.transform(
            at,
            lambda k: F.when(
                (F.get(ordered, k)["h"] == F.get(ordered, k - 1)["h"])
                | (F.get(ordered, k)["h"] == F.get(ordered, k + 1)["h"]),
                F.get(ordered, k)["p"],
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(F.filter(twice, lambda p: p.isNotNull())),
            start,
            lambda a, p: F.struct((a["n"] + p + window - F.greatest(a["end"], p)).alias("n"), (p + window).alias("end")),
            lambda a: a["n"],
        )

    # one-element array: binds the sorted windows once, so that they are not sorted again for each position
    return F.transform(F.array(marked), count)[0]


@names_apart
def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Every row of docs with its measures, verdict and cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    n_lines, n_lines_removed (long), lost (double, share of word characters in removed lines) and
    clean_text (string). A null or empty text has no words and fails the base rules. Repeated rows are
    judged one by one; columns of docs with these names are replaced; an empty table gives an empty one.
    The work stays within each row, so nothing is shuffled; a task holds a few arrays of the words and
    lines of one text at a time, about ten times its size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", F.split(text, "\n"))
    made = made.withColumn("_hashes", repeated_words(F.col("_words"), rules.window))
    made = made.withColumn("_low", F.lower(text))
    suspect = F.regexp_count(text, F.lit(SUSPECT)) >= 3
    furniture = reduce(lambda a, b: a | b, (F.contains("_low", F.lit(x)) for x in rules.boilerplate))
    judge = lambda rule: F.transform("_lines", lambda x: F.struct(x.alias("line"), rule(x, rules).alias("why")))
    made = made.withColumn("_judged", F.when(suspect | furniture, judge(line_failure)).otherwise(judge(short_failure)))
    full = F.filter("_lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    made = made.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "_full": full,
            "n_repeat_words": F.when(
                F.size(F.array_distinct("_hashes")) < F.size("_hashes"), covered(F.col("_hashes"), rules.window)
            )
            .otherwise(0)
            .cast("long"),
            "_left": F.filter("_judged", lambda x: x["why"].isNull()),
        }
    )
    squeeze = lambda c: F.length(F.regexp_replace(c, r"[\x20\x09-\x0D]+", ""))
    made = made.withColumns(
        {
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_lines_removed": (F.size("_lines") - F.size("_left")).cast("long"),
            "clean_text": F.array_join(F.transform("_left", lambda x: x["line"]), "\n"),
        }
    )
    made = made.withColumn(
        "lost",
        F.when((F.col("n_lines_removed") > 0) & (F.col("word_chars") > 0), 1 - squeeze(F.col("clean_text")) / F.col("word_chars")).otherwise(0.0),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    made = made.drop("base_failed", "kept").withColumn("_failed", failed)
    # as rows of a generator: a filter on a verdict would else be pushed below the measures and compute them again
    verdict = F.struct(F.col("_failed").alias("base_failed"), (~F.col("_failed") & (F.col("lost") <= rules.max_lost)).alias("kept"))
    made = made.select("*", F.inline(F.array(verdict)))
    return made.drop("_words", "_lines", "_hashes", "_judged", "_full", "_left", "_low", "_failed")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others go on with their failing lines removed and n_chars, if there, counted anew.

    Null and empty texts go, as they have too few words; a null doc_id is no matter; repeated rows are judged one
    by one, alike; an empty table gives an empty one; extra columns stay as they are, also those named like
    the measures.
    """
    return cleaned(docs)


@names_apart
def cleaned(docs: DataFrame) -> DataFrame:
    judged = clean(docs.select(F.struct(*docs.columns).alias("own"), "text"))
    text = F.when(F.col("n_lines_removed") > 0, F.col("clean_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return judged.filter("kept").select(*(new.get(c, F.col("own")[c]).alias(c) for c in docs.columns))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + k AS p FROM rep, (SELECT unnest(range(0, 5)) AS k)) GROUP BY r),
l AS (SELECT r, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (
  SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM w)),
m AS (SELECT *, len(lw) AS n, len(regexp_extract_all(line, '[#*$%&<>]')) AS sy, len(regexp_extract_all(line, '!!+')) AS sh,
  len(regexp_extract_all(line, '[#*$%&<>|»·•/!]')) AS su, len(list_filter(lw, lambda x: x IN ('|', '>', '»', '·', '•', '/'))) AS ba,
  coalesce(lw[-1][-1], '') AS last FROM l),
j AS (SELECT r, pos, line, lw, n, CASE
  WHEN n = 0 THEN false
  WHEN su >= 3 AND ((sy >= 3 AND sy >= n * 0.5) OR (sh >= 3 AND sh >= n * 0.5) OR (ba >= 3 AND ba >= n * 0.2)) THEN true
  WHEN n < 3 AND last NOT IN ('.', '!', '?', ':', ';', ',', '…', '"', '''', '”', '’', '»', ')', ']', '。', '！', '？')
    AND len(regexp_extract_all(line, '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}]')) < 8 THEN true
  WHEN n <= 40 AND regexp_matches(lower(line), 'all rights reserved|accept cookies|cookie policy|enable javascript|javascript is disabled|lorem ipsum|privacy policy|terms of service|terms of use|sign up for our newsletter|skip to content|click here to|follow us on|share this article') THEN true
  ELSE false END AS bad FROM m),
s AS (SELECT r, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
  coalesce(sum(length(array_to_string(lw, ''))) FILTER (WHERE bad), 0) AS lost_chars FROM j GROUP BY r),
a AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars
  FROM w JOIN s USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND (lost_chars = 0 OR 1 - (word_chars - lost_chars) / greatest(word_chars, 1) <= 0.3) AS kept
FROM a
"""
