"""Arrow and numpy helpers for whole texts in batches.

A batch of texts is cut into chunks, chunks become integer codes, and all later
work is done once for each distinct chunk and gathered back by code. No helper
keeps more than one slice of texts (``SLICE_BYTES``) in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column of texts as one large_string array in which null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) and np.frombuffer(column.buffers()[1], np.int64)[column.offset]:  # some string kernels misread an array that starts inside its buffers
        column = column.take(pa.array(np.arange(len(column))))
    return column


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most about ``limit`` bytes of text, and one row at least: large batches are cut evenly, small ones joined."""
    held, held_size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        even = max(1, -(-int(ends[-1]) // max(1, -(-int(ends[-1]) // limit))))
        part = np.maximum(ends - 1, 0) // even
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            n = int(size[a:b].sum()) + 16 * (b - a)
            if held and held_size + n > limit:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, held_size = [], 0
                pa.default_memory_pool().release_unused()
            held.append(batch.slice(a, b - a))
            held_size += n
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each s, n."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: codes of all words, the distinct words, and each text's offsets."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    coded = flat.dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        bounds = offsets(keep)[bounds]
        codes = codes[keep]
    return codes, names, bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each row's values; rows are given by offsets and may be empty."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def hashed(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, equal on every machine and in every run."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    raw = names.cast(pa.large_binary()).to_pylist()
    return np.fromiter((h(x) for x in raw), np.uint64, len(raw))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words that lie in one row, and the rows' offsets among the windows."""
    size = np.diff(bounds)
    count = np.maximum(size - n + 1, 0)
    total = max(len(h) - n + 1, 0)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + total])
    return out[ranges(bounds[:-1], count)], offsets(count)
