"""Packing of token sequences: best-fit decreasing over the whole table.

Overlong documents are first cut into full windows; the remainders (at most
window - 1 tokens) are packed by best-fit decreasing. Items of one length are
alike, so the packing runs on the histogram of lengths: at most window - 1
counts reach the driver, whatever the size of the table. Its result is a list
of runs (items i0 to i1 of a length go to consecutive windows), by which each
piece, numbered within its length by many tasks, finds its own place.

Defined results: a null text is empty; an empty document is its end id alone;
repeated rows are packed as often as they occur; ties are broken by doc_id,
start and checksum; an empty table gives no rows. Extra input columns are
ignored, so their names can't clash. Two rows of one doc_id are two documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.columns import as_text, slices
from colonnade.llm.sparkio import numbered, stored
from colonnade.llm.wordbpe import word_bpe

WINDOW = 2048


class CapacityTree:
    """A segment tree over capacities 0..top: first(s) is the least capacity of at least s that is in use."""

    def __init__(self, top: int):
        self.leaves = 1 << max(1, top).bit_length()
        self.used = np.zeros(2 * self.leaves, bool)

    def set(self, capacity: int, used: bool) -> None:
        k = capacity + self.leaves
        self.used[k] = used
        while k > 1:
            k //= 2
            self.used[k] = self.used[2 * k] or self.used[2 * k + 1]

    def first(self, s: int) -> int | None:
        k = s + self.leaves
        if self.used[k]:
            return s
        while k > 1:
            if k % 2 == 0 and self.used[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.used[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def best_fit_runs(counts: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing of counts[s] items of each size s: runs and the number of windows.

    A run (s, i0, i1, w0, q, at) puts item i of size s (i0 <= i < i1) into window
    w0 + (i - i0) // q at offset at + (i - i0) % q * s. The windows are those of
    the item-by-item algorithm: an item goes to the tightest open window, and the
    window it enters is the tightest for the next item of its size as long as
    that fits.
    """
    tree, opened = CapacityTree(window), 0
    open_by: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    runs: list[tuple[int, int, int, int, int, int]] = []

    def give(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_by[capacity].append((first, n))
            tree.set(capacity, True)

    for s in sorted(counts, reverse=True):
        i, n = 0, counts[s]
        while i < n:
            r = tree.first(s)
            if r is None:
                r, first, m = window, opened, -(-(n - i) // (window // s))
                opened += m
            else:
                first, m = open_by[r].popleft()
                if not open_by[r]:
                    tree.set(r, False)
            q = r // s
            full = min(m, (n - i) // q)
            if full:
                runs.append((s, i, i + full * q, first, q, window - r))
                i += full * q
                give(r - q * s, first, full)
            if full < m and i < n:
                runs.append((s, i, n, first + full, q, window - r))
                give(r - (n - i) * s, first + full, 1)
                i, full = n, full + 1
            if full < m:
                open_by[r].appendleft((first + full, m - full))
                tree.set(r, True)
    return np.array(runs, np.int64).reshape(-1, 6), opened


def cut(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each piece: full windows, then the remainder."""
    n = -(-lengths // window)
    row = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
    return row, start, np.minimum(window, lengths[row] - start)


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(path)
        for batch in slices(batches):
            ids, bounds = model.encode(as_text(batch.column("text")))
            n = np.diff(bounds)
            row, start, length = cut(n + 1, window)
            wide = np.insert(ids.astype("<u4"), bounds[1:], end_id)
            at = (bounds[:-1] + np.arange(len(n)))[row] + start
            raw = memoryview(wide.tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(at))
            doc = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (start, length, crc, (n + 1)[row]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def placer(runs: np.ndarray, windows: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            whole = length == window
            sequence, offset = np.where(whole, windows + rank, 0), np.zeros(len(rank), np.int64)
            if len(runs):
                r = runs[np.maximum(np.searchsorted(key, (length << 44) + rank, "right") - 1, 0)]
                j = rank - r[:, 1]
                sequence = np.where(whole, sequence, r[:, 3] + j // r[:, 4])
                offset = np.where(whole, 0, r[:, 5] + j % r[:, 4] * length)
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """parts (doc_id, start, length, ids_crc32, doc_tokens; length 1 to window) with sequence_id and offset."""
    parts = stored(parts, "pieces")
    counts = {r[0]: r[1] for r in parts.where(F.col("length") < window).groupBy("length").count().collect()}
    runs, windows = best_fit_runs(counts, window)
    ranked = numbered(parts, ["length"], ["doc_id", "start", "ids_crc32"], "rank")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*columns, "rank").mapInArrow(placer(runs, windows, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    return pack(pieces(docs, path, end_id, window), window)
