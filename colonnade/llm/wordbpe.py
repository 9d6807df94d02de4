"""The word tokenizer of a ``tokenizers`` file, encoded once for each distinct chunk.

Merging is done for all distinct pieces in step: a matrix of symbols, a hashed
table of merges, and the leftmost pair of least rank of each row contracted
until no row has a pair. Chunks with characters beyond Latin letters go to the
library itself, whose normaliser then decides. Ids equal the library's.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from colonnade.llm.columns import offsets, ranges

_CACHE = 300_000
_NONE = np.int64(1) << 40


class PairTable:
    """(left, right) -> (rank, merged) by open addressing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        n = len(left)
        self.bits = max(4, int(np.ceil(np.log2(max(n, 1) * 4))))
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int64)
        self.to = np.zeros(size, np.int64)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        _, first = np.unique(key, return_index=True)
        todo = np.sort(first)
        slot = self._slot(key[todo])
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.key[slot] == -1
            _, at = np.unique(slot[free], return_index=True)
            win = np.flatnonzero(free)[at]
            s, t = slot[win], todo[win]
            self.key[s], self.rank[s], self.to[s] = key[t], t, merged[t]
            left_over = np.ones(len(todo), bool)
            left_over[win] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        slot = self._slot(key)
        rank, to = np.full(key.shape, _NONE, np.int64), np.zeros(key.shape, np.int64)
        todo = None
        for _ in range(self.probes):
            k, s = (key, slot) if todo is None else (key[todo], slot[todo])
            there = self.key[s]
            hit = there == k
            if todo is None:
                rank[hit], to[hit] = self.rank[s[hit]], self.to[s[hit]]
                todo = np.nonzero(~hit & (there != -1))
            else:
                at = tuple(i[hit] for i in todo)
                rank[at], to[at] = self.rank[s[hit]], self.to[s[hit]]
                more = ~hit & (there != -1)
                todo = tuple(i[more] for i in todo)
            if not len(todo[0]):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return rank, to


def contract(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ragged rows of symbols, each contracted to its fixpoint: symbols and lengths.

    Rows of like length form a matrix; a merge links its symbol to the one after
    next, so that nothing moves. Rows that are done are left out once they are half.
    """
    out_len = lengths.astype(np.int64).copy()
    starts = offsets(out_len)[:-1]
    order = np.argsort(out_len, kind="stable")
    result, place, done_at = [], np.zeros(len(order), np.int64), 0
    for lot in np.array_split(order, max(1, len(order) // 8192 + 1)):
        n = out_len[lot]
        width = int(n.max(initial=0))
        if not width:
            continue
        made = np.full((len(lot), width + 1), -1, np.int64)
        inside = np.arange(width + 1)[None, :] < n[:, None]
        made[inside] = symbols[ranges(starts[lot], n)]
        rows = np.flatnonzero(n > 1)
        m = made[rows]
        rank, to = np.full(m.shape, _NONE, np.int64), np.zeros(m.shape, np.int64)
        both = np.zeros(m.shape, bool)
        both[:, :-1] = m[:, 1:] >= 0
        rank[both], to[both] = table.find(m[both], m[:, 1:][both[:, :-1]])
        after = np.tile(np.arange(1, width + 2), (len(rows), 1))
        before = after - 2
        while len(rows):
            at = rank.argmin(1)
            base = np.arange(len(rows)) * (width + 1)
            flat_m, flat_rank, flat_to, flat_after, flat_before = (x.reshape(-1) for x in (m, rank, to, after, before))
            ok = flat_rank[base + at] < _NONE
            if 2 * np.count_nonzero(ok) < len(rows):
                made[rows[~ok]] = m[~ok]
                rows, m, rank, to, after, before = (x[ok] for x in (rows, m, rank, to, after, before))
                continue
            base, at = base[ok], at[ok]
            here = base + at
            gone = base + flat_after[here]
            flat_m[here] = flat_to[here]
            flat_m[gone], flat_rank[gone] = -1, _NONE
            following, previous = flat_after[gone], flat_before[here]
            flat_after[here] = following
            good = following <= width
            flat_before[(base + following)[good]] = at[good]
            left = np.concatenate([here, (base + previous)[previous >= 0]])
            right = np.concatenate([base + np.minimum(following, width), here[previous >= 0]])
            r, t = table.find(flat_m[left], np.where(flat_m[right] < 0, 0, flat_m[right]))
            r[: len(here)][flat_m[right[: len(here)]] < 0] = _NONE
            flat_rank[left], flat_to[left] = r, t
        keep = made >= 0
        n = np.count_nonzero(keep, 1)
        result.append(made[keep])
        place[lot] = offsets(n)[:-1] + done_at
        done_at += int(n.sum())
        out_len[lot] = n
    flat = np.concatenate(result) if result else np.zeros(0, np.int64)
    return flat[ranges(place, out_len)], out_len


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class WordBpe:
    """The tokenizer of one file. ``encode`` takes texts and gives all ids with each text's offsets."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.load(open(path))["model"]
        vocab, merges = model["vocab"], [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        end = model["end_of_word_suffix"]
        ids = lambda k: np.fromiter((vocab[x[k]] for x in merges), np.int64, len(merges))
        self.table = PairTable(ids(0), ids(1), np.fromiter((vocab[a + b] for a, b in merges), np.int64, len(merges)))
        letter = byte_letters()
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + end] for b in range(256)], np.int64)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.known = pa.array([], pa.large_string())
        self.known_ids = ragged(np.zeros(0, np.uint16), np.zeros(1, np.int64))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are not empty, and their counts."""
        raw = pieces.cast(pa.large_binary())
        n = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(n):
            return np.zeros(0, np.int64), n
        start = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]
        by = np.frombuffer(raw.buffers()[2], np.uint8)[start : start + int(n.sum())]
        symbols = self.inner[by]
        ends = np.cumsum(n) - 1
        symbols[ends] = self.last[by[ends]]
        return contract(symbols, n, self.table)

    def _cut(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of Latin letters, digits and signs: cut by the pattern, each distinct piece encoded once."""
        cut = [self.split(c) for c in chunks.to_pylist()]
        index: dict[str, int] = {}
        which = np.array([index.setdefault(p, len(index)) for ps in cut for p in ps], np.int64)
        flat, n = self._pieces(pa.array(list(index), pa.large_string()))
        per = offsets(np.fromiter(map(len, cut), np.int64, len(cut)))
        return flat[ranges(offsets(n)[which], n[which])], np.diff(offsets(n[which])[per])

    def _words(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that are one run of Latin letters and at most one sign."""
        bare = pc.utf8_rtrim(chunks, ".,;:!?")
        coded = bare.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        flat, n = self._pieces(coded.dictionary)
        sign = np.flatnonzero(pc.binary_length(chunks).to_numpy(zero_copy_only=False) > pc.binary_length(bare).to_numpy(zero_copy_only=False))
        size = n[code]
        size[sign] += 1
        out = np.zeros(int(size.sum()), np.int64)
        ends = np.cumsum(size)
        inside = np.ones(len(out), bool)
        inside[ends[sign] - 1] = False
        out[inside] = flat[ranges(offsets(n)[code], n[code])]
        last = pc.utf8_slice_codeunits(chunks.take(pa.array(sign)), -1).cast(pa.large_binary())
        out[ends[sign] - 1] = self.last[np.frombuffer(b"".join(last.to_pylist()), np.uint8)]
        return out, size

    def _library(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch(chunks.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.int64), np.fromiter(map(len, got), np.int64, len(got))

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks; none holds an ASCII space or line end."""
        latin = pc.match_substring_regex(chunks, r"^[\x21-\x7e¡-į]+$")
        latin = pc.and_(latin, pc.invert(pc.match_substring(chunks, "<|")))
        lower = pc.if_else(latin, pc.utf8_lower(chunks), chunks)
        word = pc.and_(latin, pc.match_substring_regex(lower, r"^[a-zà-öø-įß]+[.,;:!?]?$"))
        kind = np.where(word.to_numpy(zero_copy_only=False), 0, np.where(latin.to_numpy(zero_copy_only=False), 1, 2))
        lots = [np.flatnonzero(kind == k) for k in range(3)]
        flat, size = zip(*(f(lower.take(pa.array(lot))) for f, lot in zip((self._words, self._cut, self._library), lots)))
        place = np.argsort(np.concatenate(lots), kind="stable")
        made = ragged(np.concatenate(flat).astype(np.uint16), offsets(np.concatenate(size)))
        return made.take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as the library gives them without special tokens, and each text's offsets.

        Cutting at ASCII spaces and line ends is safe: the library drops white
        space, and no piece, normal form or special token reaches across it.
        ASCII letters may be lowered first unless a special token may occur.
        """
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary
        at = pc.index_in(names, self.known)
        new = names.filter(at.is_null())
        fresh = self._chunks(new)
        where = at.to_numpy(zero_copy_only=False)
        where = np.where(np.isnan(where), 0, where).astype(np.int64) if at.null_count else where.astype(np.int64)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        where[missing] = len(self.known) + np.arange(len(new))
        every = pa.concat_arrays([self.known_ids, fresh])
        got = every.take(pa.array(where[coded.indices.to_numpy(zero_copy_only=False)]))
        flat, bound = got.values.to_numpy(), got.offsets.to_numpy()
        flat, bound = flat[bound[0] : bound[-1]], bound - bound[0]
        if (room := _CACHE - len(self.known)) > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            kept = pa.concat_arrays([self.known_ids, fresh.slice(0, room)])
            self.known_ids = kept
        return flat, bound[bounds]


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One tokenizer for each file and Python worker."""
    return WordBpe(path)
