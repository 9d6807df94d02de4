"""Quality rules, line first: bad lines are removed, and documents that lose too much text are rejected.

A line fails if it is navigation (separators between its words), boilerplate
(licence, cookie, sign-in and similar phrases), shouting (most of its words end
in repeated marks) or a fragment (fewer than SHORT words and no punctuation that
ends a sentence). Blank lines are neither kept nor lost. A document is rejected
if it fails the base rules or if failing lines hold more than LOST of the
characters of its lines with words.

Defined results: a null or empty text has no words and fails the base rules; its
cleaned text is as it was (null or empty). Rows are independent, so ties and
repeats don't matter. Other columns pass through ``clean`` untouched, whatever
their names; ``verdicts`` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.columns import as_text, hashed, mixed, offsets, slices, sums, windows, words

WINDOW, SHORT, LOST = 5, 5, 0.5
NAVIGATION = r"(?:^|\s)(?:\||»|›|•|·|::|>)(?:\s|$).*\s(?:\||»|›|•|·|::|>)(?:\s|$)"
BOILERPLATE = r"(?i)licensed under|all rights reserved|released under the|this work is licensed|©|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|enable javascript|subscribe to our|sign up for|log in to|click here|powered by"
SHOUT = r"[!?]{2,}"
ENDED = r"[.!?。！？…:;][\"'”’»)\]]*(?:\s|$)"


def repeated_words(h: np.ndarray, bounds: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of n words that the row holds twice or more."""
    wins, at = windows(h, bounds, n)
    if not len(wins):
        return np.zeros(len(bounds) - 1, np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = mixed(wins + mixed(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(wins), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.flatnonzero(twice)
    word = bounds[row[hit]] + hit - at[row[hit]]
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, word, 1)
    np.add.at(step, word + n, -1)
    return sums(np.cumsum(step[:-1]) > 0, bounds)


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts of each text, its lines, and which of them stay."""
    codes, names, bounds = words(texts)
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.diff(bounds)
    blanks = number(pc.count_substring_regex(texts, r"[\x20\x09-\x0d]"))
    h = hashed(names)
    repeat = repeated_words(h[codes] if len(h) else np.zeros(0, np.uint64), bounds)
    parts = pc.split_pattern(texts, "\n")
    at = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    lines = parts.flatten()
    filled = pc.match_substring_regex(lines, r"[^\x20\x09-\x0d]").to_numpy(zero_copy_only=False)
    coded = lines.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    key = (row * (len(coded.dictionary) + 1) + code)[filled]
    distinct = np.unique(key) // (len(coded.dictionary) + 1)
    n_dup = sums(filled, at) - np.bincount(distinct, minlength=len(texts))

    kinds = coded.dictionary  # each distinct line is judged once
    matches = lambda x: pc.match_substring_regex(kinds, x).to_numpy(zero_copy_only=False)
    size = number(pc.count_substring_regex(kinds, r"[^\x20\x09-\x0d]+"))
    loud = number(pc.count_substring_regex(kinds, SHOUT))
    bad = matches(NAVIGATION) | matches(BOILERPLATE) | (loud * 2 > size) & (loud > 2) | (size < SHORT) & ~matches(ENDED)
    length = number(pc.utf8_length(kinds))
    stays = ~(bad[code] & filled)
    chars = length[code] * filled
    lost, whole = sums(chars * ~stays, at), sums(chars, at)
    base = (n_words < 10) | (100 * repeat > 20 * n_words)
    return {
        "n_words": n_words, "word_chars": number(pc.utf8_length(texts)) - blanks, "n_symbols": number(pc.count_substring_regex(texts, r"[#*$%&|<>]")),
        "n_dup_lines": n_dup, "n_repeat_words": repeat, "base_failed": base, "kept": ~base & (lost <= LOST * whole), "lines": lines, "line_at": at, "stays": stays,
    }


def cleaned(got: dict) -> pa.Array:
    """The texts without their failing lines."""
    stays = got["stays"]
    lines = got["lines"].filter(pa.array(stays)).cast(pa.large_string())
    at = offsets(stays)[got["line_at"]]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), lines), pa.scalar("\n", pa.large_string()))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            got = measured(as_text(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[k]) for k in FIELDS)], ["doc_id", *FIELDS])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; text has lost its failing lines."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            got = measured(as_text(batch.column(at)))
            columns = [cleaned(got).cast(batch.schema.field(k).type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(got["kept"]))

    return docs.mapInArrow(run, docs.schema)
