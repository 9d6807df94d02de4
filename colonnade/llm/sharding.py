"""Sharding of documents by size: indivisible groups of equal texts, packed best-fit decreasing.

Groups of equal texts are sized by a pre-aggregated shuffle. Groups of one size
are alike, so the packing runs on the histogram of sizes: as S different sizes
add up to S^2 / 2 bytes at least, the driver gets at most sqrt(2 * total) counts
(under 250,000 for 30 GB). Sizes, in descending order, enter the bin of tightest
remaining capacity, found in a balanced tree; as long as it fits, that bin stays
the tightest for the next group of the size, so groups enter in runs, and the
result equals the packing group by group. The least capacity that needs no more
bins than asked is found by bisection. A group too large for an even share gets
a shard of its own. Each group, numbered within its size by many tasks, finds
its run.

Defined results: a null text has the fixed size alone, and all null texts are
one group, apart from empty ones; repeated rows stay rows, and null ids stay
null; groups of one size are ordered by their texts' checksums; shards may stay
empty only where there are fewer groups than shards; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.sparkio import numbered, stored, unsigned_crc32


class Treap:
    """A balanced tree of (remaining capacity, bin), by which the tightest bin is found."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 88172645463325252

    def _priority(self) -> int:
        x = self.seed
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.seed = x
        return x

    def _split(self, t: list | None, key: tuple) -> tuple[list | None, list | None]:
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, key: tuple) -> None:
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, [key, self._priority(), None, None]), b)

    def take_tightest(self, size: int) -> tuple | None:
        """Removes and returns the least (remaining, bin) with remaining >= size."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        up, t = None, b
        while t[2] is not None:
            up, t = t, t[2]
        if up is None:
            b = t[3]
        else:
            up[2] = t[3]
        self.root = self._join(a, b)
        return t[0]


#: size, first and last group of the run (by number within the size, last excluded), bin
Run = tuple[int, int, int, int]


def best_fit_decreasing(counts: dict[int, int], capacity: int, bins: int | None = None) -> list[Run] | None:
    """The runs in which counts[size] groups of each size enter bins; None where ``bins`` bins of ``capacity`` don't hold them."""
    tree, opened, out = Treap(), 0, []
    for size in sorted(counts, reverse=True):
        at, n = 0, counts[size]
        while at < n:
            got = tree.take_tightest(size)
            if got is None:
                if size > capacity or opened == bins:
                    return None
                got, opened = (capacity, opened), opened + 1
            m = min(n - at, got[0] // size)
            out.append((size, at, at + m, got[1]))
            at += m
            tree.add((got[0] - m * size, got[1]))
    return out


def even_bins(counts: dict[int, int], bins: int) -> list[Run]:
    """The runs in which counts[size] groups of each size enter bins of the least capacity that best-fit decreasing meets."""
    counts, out, first = dict(counts), [], 0
    total = sum(s * n for s, n in counts.items())
    taken: dict[int, int] = {}
    sizes = sorted(counts, reverse=True)
    while sizes and bins - first > 1 and sizes[0] * (bins - first) > total:
        size = sizes[0]
        done = taken.get(size, 0)
        out.append((size, done, done + 1, first))
        taken[size], first, total = done + 1, first + 1, total - size
        counts[size] -= 1
        if not counts[size]:
            sizes.pop(0), counts.pop(size)
    if not sizes:
        return out
    left = bins - first
    low = high = max(-(-total // left), sizes[0])
    step = max(1, high >> 12)
    while (best := best_fit_decreasing(counts, high, left)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        mid = (low + high) // 2
        if (got := best_fit_decreasing(counts, mid, left)) is None:
            low = mid + 1
        else:
            best, high = got, mid
    return out + [(s, a + taken.get(s, 0), b + taken.get(s, 0), first + k) for s, a, b, k in best]


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: one more shard would move rows)."""
    text = F.col("text")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            unsigned_crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.when(text.isNull(), F.lit(b"-")).otherwise(F.unhex(F.md5(F.encode(text, "UTF-8")))).alias("group"),
        ),
        "sizes",
    )
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    counts = groups.groupBy("bytes").count().toPandas()  # one row for each size
    runs = np.array(sorted(even_bins(dict(zip(counts["bytes"].tolist(), counts["count"].tolist())), shards)), np.int64).reshape(-1, 4)
    spread = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = spread.value
        heads = np.flatnonzero(np.diff(held[:, 0], prepend=-1))
        of = held[heads, 0]
        for batch in batches:
            size, rank = batch.column("bytes").to_numpy(), batch.column("rank").to_numpy()
            # a size's runs lie next to each other; the run is the last that begins at the rank or before
            run = heads[np.searchsorted(of, size)]
            last = np.append(heads[1:], len(held))[np.searchsorted(of, size)]
            while len(more := np.flatnonzero((run + 1 < last) & (held[np.minimum(run + 1, len(held) - 1), 1] <= rank))):
                run[more] += 1
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(held[run, 3].astype(np.int32))], ["group", "shard"])

    ranked = numbered(groups, ["bytes"], ["group"], "rank").select("group", "bytes", "rank")
    placed = ranked.mapInArrow(place, "group binary, shard int")
    out = rows.join(placed, "group").select("doc_id", "size", "text_crc32", "shard")
    out = numbered(stored(out, "placed"), ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
