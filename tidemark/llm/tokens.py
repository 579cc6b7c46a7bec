"""Token counts: overlapping chunks of huge documents, spliced where both encodings agree."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import names_apart, others, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a chunk, and of the overlap of two at first.
CHUNK = 1 << 14
OVERLAP = 1 << 10
#: Tokens on each side of a splice that both encodings must share.
AGREE = 8
#: Characters of the texts that are encoded in one call.
CALL = 1 << 20
#: Words that a task remembers, and the most bytes of such a word.
MOST_KNOWN, LONGEST_KNOWN = 1_000_000, 64


def encoder(content: bytes) -> Callable:
    """Tokenizer from a tokenizers file's content, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(content.decode())
    made.no_truncation()
    made.no_padding()
    return made


def space_parts(tokenizer, content: bytes) -> bool:
    """Whether white space is dropped and parts a text into words that are encoded each on its own.

    So it is if the first step of the pre-tokenizer keeps only what a pattern matches and drops each kind of white space
    between two letters, if the normalizer has only steps that take no characters from one word into the next, and
    if no added token has white space or takes some in. Any other tokenizer is taken not to.
    """
    made = json.loads(content)
    steps = lambda x, inner: [] if not x else x[inner] if x["type"] == "Sequence" else [x]
    first = steps(made["pre_tokenizer"], "pretokenizers")[:1]
    if not first or first[0].get("behavior") != "Removed" or not first[0].get("invert"):
        return False
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(x["type"] not in ("NFC", "Lowercase") and x != spaces for x in steps(made["normalizer"], "normalizers")):
        return False
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or len(x["content"].split()) != 1 for x in made["added_tokens"]):
        return False
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    return all([at for _, at in cut(f"a{s}b")] == [(0, 1), (2, 3)] for s in " \t\n\x0b\x0c\r")


def encoded(tokenizer, text: str, at: int) -> np.ndarray:
    """Rows (id, start, end) of the tokens of a text that begins at place at."""
    e = tokenizer.encode(text, add_special_tokens=False)
    made = np.empty((len(e.ids), 3), dtype=np.int64)
    made[:, 0] = e.ids
    made[:, 1:] = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
    return made


def splice(left: np.ndarray, right: np.ndarray, text: str, begin: int, end: int, agree: int) -> tuple[int, int] | None:
    """Where to leave left and enter right, as row numbers, or None if no place in begin..end is proven.

    A proven place has white space in the text before it, and agree tokens on either side of it that both
    encodings have with the same ids and offsets. White space ends a piece for the merges, so what is
    left of it can't change what is right of it once both agree there. The place nearest the middle is taken.
    """
    a = np.flatnonzero((left[:, 1] >= begin) & (left[:, 2] <= end))
    b = np.flatnonzero((right[:, 1] >= begin) & (right[:, 2] <= end))
    _, ka, kb = np.intersect1d(left[a, 1], right[b, 1], return_indices=True)
    xs, ys = a[ka], b[kb]
    for k in np.argsort(np.abs(left[xs, 1] - (begin + end) // 2), kind="stable").tolist():
        x, y = int(xs[k]), int(ys[k])
        if x - agree < a[0] or y - agree < b[0] or x + agree > a[-1] + 1 or y + agree > b[-1] + 1:
            continue
        place = int(left[x, 1])
        if text[place - 1] not in " \t\n\r" or left[x - 1, 2] > place - 1:
            continue
        if np.array_equal(left[x - agree : x + agree], right[y - agree : y + agree]):
            return x, y
    return None


def tokens_of(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> Iterator[np.ndarray]:
    """The tokens (id, start, end) of a text, in parts that follow each other.

    The text is encoded in chunks that overlap. Where no place in an overlap is proven it is widened twofold
    and the next chunk encoded again from further left; once it reaches back over all that isn't spliced
    yet, that and as much again are encoded as one.
    """
    place, end = 0, min(len(text), chunk)  # text from place on isn't spliced yet; left covers it up to end
    left = encoded(tokenizer, text[:end], 0)
    while end < len(text):
        wide, found = min(overlap, end - place), None
        while found is None and wide < end - place:
            after = min(len(text), end - wide + max(chunk, 2 * wide))
            right = encoded(tokenizer, text[end - wide : after], end - wide)
            found = splice(left, right, text, end - wide, end, agree)
            wide *= 2
        if found is None:
            end = min(len(text), place + 2 * (end - place))
            left = encoded(tokenizer, text[place:end], place)
        else:
            yield left[: found[0]]
            left = right[found[1] :]
            place, end = int(left[0, 1]), after
    yield left


@names_apart
def count_tokens(docs: DataFrame, content: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs without text, with n_bytes (UTF-8) and n_tokens (long).

    content is that of a tokenizers file; it is sent to the tasks once. Every text is read in chunks of so many
    characters that overlap, and the chunks' encodings are spliced; a text no longer than a chunk has one and
    needs no splice. So a task holds the tokens of a chunk and not of a text. Where the tokenizer parts texts at white
    space (see space_parts()), a text of one chunk is counted as the sum of its words', and words of up to LONGEST_KNOWN
    bytes are encoded once while a task remembers them. No begin, end or other tokens are added; special
    strings inside texts count as the tokenizer has them. A null text is empty and has no tokens; repeated rows are counted
    one by one; columns of docs with the new names are replaced; an empty table gives an empty one. Nothing is shuffled.
    """
    kept = others(docs, ("text", "n_bytes", "n_tokens"))
    given = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text"))
    given = given.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    given = given.select(*kept, "n_bytes", F.lit(0).cast("long").alias("n_tokens"), "_text")
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(shared.value)
        known = {} if space_parts(tokenizer, shared.value) else None
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(kept) + 1)), pa.array(counts(tokenizer, b.column(len(kept) + 2), chunk, overlap, known), pa.int64())],
                [*kept, "n_bytes", "n_tokens"],
            )

    return given.mapInArrow(run, given.drop("_text").schema)


def counts(tokenizer, texts: pa.Array, chunk: int, overlap: int, known: dict[bytes, int] | None = None) -> list[int]:
    made: list[int] = [0] * len(texts)
    group: list[tuple[int, str]] = []
    held = 0

    def flush() -> None:
        if known is not None:
            found = counts_by_word(tokenizer, [t.encode() for _, t in group], known)
        else:
            found = [len(e.ids) for e in tokenizer.encode_batch_fast([t for _, t in group], add_special_tokens=False)]
        for (k, _), n in zip(group, found, strict=True):
            made[k] = n
        group.clear()

    for k, value in enumerate(texts):
        text = value.as_py()
        if len(text) > chunk:
            made[k] = sum(len(part) for part in tokens_of(tokenizer, text, chunk, overlap))
            continue
        group.append((k, text))
        held += len(text)
        if held >= CALL:
            flush()
            held = 0
    flush()
    return made


def counts_by_word(tokenizer, texts: list[bytes], known: dict[bytes, int]) -> list[int]:
    """Tokens of each text as the sum over its words; known has those of words seen, and gets the new ones."""
    if len(known) > MOST_KNOWN:
        known.clear()
    split = [t.split() for t in texts]
    new = list({w for words in split for w in words}.difference(known))
    for at in range(0, len(new), 4096):
        some = [w.decode() for w in new[at : at + 4096]]
        starts = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
        e = tokenizer.encode(" ".join(some), add_special_tokens=False)
        places = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        n = np.bincount(np.searchsorted(starts, places, side="right") - 1, minlength=len(some))
        known.update(zip(new[at : at + 4096], n.tolist(), strict=True))
    long = [w for w in new if len(w) > LONGEST_KNOWN]
    made = [sum(map(known.__getitem__, words)) for words in split]
    for w in long:
        del known[w]
    return made


def tokenizer_content(name: str = TOKENIZER) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs, tokenizer_content())
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
