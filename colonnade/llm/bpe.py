"""Byte-level BPE by DuckDB: recursive queries over token-position rows in each partition.

Texts are cut where no piece can reach across (a single space between
characters that are not white space), each distinct chunk is cut into pieces by
the pattern, and each distinct piece becomes one row for each of its symbols. A
recursive query joins neighbouring rows to the merge table and contracts each
word's leftmost pair of least rank, until no word has a pair left. Decoding joins
ids to the vocabulary and aggregates bytes in order. All of it is local to a
task: no shuffle, and memory is bounded by a slice of texts, a cache of pieces and
a lot of pieces; DuckDB has no folder to spill to. Pieces of _LONG bytes or more,
which the recursion would contract in quadratic time, have the same pairs merged
in the same order by a heap.

Defined results: a null text is empty; an empty text has no ids and decodes to
no bytes; rows are independent, so repeats and ties don't matter; lone
surrogates can't occur in a Spark string. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.columns import as_text, offsets, ranges, slices
from colonnade.llm.wordbpe import ragged

_CACHE = 400_000
#: bytes of a lot's pieces, and the sum of their lengths' squares, which bounds what the recursion holds
_LOT, _SQUARES = 480_000, 6_000_000
#: bytes from which on a piece is contracted by a heap
_LONG = 256
_ODD = r"[\s\x0b]{2}|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^ | $"

CONTRACT = """
WITH RECURSIVE step(word, toks, live) AS (
    SELECT word, list(tok ORDER BY pos), true FROM symbols GROUP BY word
  UNION ALL
    (WITH positions AS (
        SELECT word, unnest(range(1, len(toks))) AS pos, unnest(list_zip(toks[:-2], toks[2:])) AS pair
        FROM step WHERE live),
    best AS (
        SELECT p.word, min(m.rank * 1073741824 + p.pos) AS best
        FROM positions p JOIN merges m ON m.pair = p.pair[1] * 65536 + p.pair[2] GROUP BY p.word)
    SELECT word, CASE WHEN best IS NULL THEN toks
        ELSE toks[: best % 1073741824 - 1] || [best // 1073741824] || toks[best % 1073741824 + 2 :] END, best IS NOT NULL
    FROM step LEFT JOIN best USING (word) WHERE live)
)
SELECT word, toks FROM step WHERE NOT live ORDER BY word
"""

class ByteBpe:
    """Encoding and decoding by one file of ranks."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.ranks, top = ranks, max(ranks.values()) + 1
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": ""})
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    left.append(ranks[token[:k]]), right.append(ranks[token[k:]]), to.append(rank)
        pair = np.array(left, np.int64) * 65536 + np.array(right, np.int64)
        merges = pa.table({"pair": pair, "rank": np.array(to, np.int64)})  # noqa: F841  read by DuckDB
        self.db.execute("CREATE TABLE merges AS SELECT pair, rank FROM merges")
        self.merges = dict(zip(pair.tolist(), to))
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int64()), "bytes": pa.array(list(ranks), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT tok, bytes FROM vocabulary")
        self.bytes: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        space = r"\p{White_Space}"
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", space).replace(r"\S", rf"\P{{White_Space}}")).findall
        self.known: dict[str, np.ndarray] = {}

    def pieces(self, new: list[str]) -> list[np.ndarray]:
        """Ids of distinct pieces of the pattern, none empty."""
        raw = [p.encode() for p in new]
        out: list[np.ndarray | None] = [self._long(x) if len(x) >= _LONG else None for x in raw]
        lot, size, squares = [], 0, 0
        for k in [k for k, x in enumerate(out) if x is None] + [-1]:
            if lot and (k < 0 or size + len(raw[k]) > _LOT or squares + len(raw[k]) ** 2 > _SQUARES):
                for j, ids in zip(lot, self._lot([raw[j] for j in lot])):
                    out[j] = ids
                lot, size, squares = [], 0, 0
            if k >= 0:
                lot.append(k)
                size, squares = size + len(raw[k]), squares + len(raw[k]) ** 2
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        """Ids of one long piece: the same contraction, with a heap of (rank, position) and links between symbols.

        The recursive query needs a step for each merge of a word and keeps them
        all, so its time and memory grow with the square of a piece's length.
        """
        n = len(raw)
        tok = self.single[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(r, k) for k in range(n - 1) if (r := merges.get(tok[k] << 16 | tok[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if tok[k] < 0 or j >= n or merges.get(tok[k] << 16 | tok[j]) != rank:
                continue
            tok[k], tok[j] = rank, -1
            after[k] = following = after[j]
            if following < n:
                before[following] = k
                if (r := merges.get(rank << 16 | tok[following])) is not None:
                    heapq.heappush(heap, (r, k))
            if (i := before[k]) >= 0 and (r := merges.get(tok[i] << 16 | rank)) is not None:
                heapq.heappush(heap, (r, i))
        return np.array([x for x in tok if x >= 0], np.int32)

    def _lot(self, raw: list[bytes]) -> list[np.ndarray]:
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw)), n)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        symbols = pa.table({"word": word, "pos": pos, "tok": self.single[np.frombuffer(b"".join(raw), np.uint8)]})
        self.db.register("symbols", symbols)
        got = self.db.sql(CONTRACT).to_arrow_table()["toks"].combine_chunks()
        self.db.unregister("symbols")
        values, at = got.flatten().to_numpy().astype(np.int32), got.offsets.to_numpy()
        return [values[a:b] for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, and each text's offsets."""
        ids, bound, order, rows = self.encode_chunks(texts)
        got = ragged(ids, bound).take(pa.array(order))
        values, at = got.values.to_numpy(), got.offsets.to_numpy()
        return values[at[0] : at[-1]], (at - at[0])[rows]

    def encode_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks and their offsets; the chunks of all texts in order, and each text's offsets there."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        begin = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 1
        code[begin[:-1]] -= 1  # no space stands before a text's first chunk
        used, code = np.unique(code, return_inverse=True)
        names = coded.dictionary.to_pylist()
        chunks = [" " + names[u >> 1] if u & 1 else names[u >> 1] for u in used.tolist()]
        whole = np.flatnonzero(odd)
        chunks += texts.take(pa.array(whole)).to_pylist()
        cut = [self.split(c) for c in chunks]
        index: dict[str, int] = {}
        which = np.array([index.setdefault(p, len(index)) for ps in cut for p in ps], np.int64)
        per = offsets(np.fromiter(map(len, cut), np.int64, len(cut)))
        del cut, chunks, names
        known = self.known
        new = [p for p in index if p not in known]
        fresh = dict(zip(new, self.pieces(new)))
        each = [known[p] if p in known else fresh[p] for p in index]
        if (room := _CACHE - len(known)) > 0:
            known.update((p, fresh[p].copy()) for p in new[:room] if len(p) < 64)
        n = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.concatenate(each) if each else np.zeros(0, np.int32)
        ids, bound = flat[ranges(offsets(n)[which], n[which])], offsets(n[which])[per]
        place = np.full(len(begin) - 1 + len(whole), 0)
        order = np.concatenate([code, len(used) + np.arange(len(whole))])
        rows = np.concatenate([np.diff(begin), np.ones(len(whole), np.int64)])
        place[plain], place[whole] = np.arange(len(plain)), len(plain) + np.arange(len(whole))
        starts = offsets(rows)
        size = rows[place]
        return ids, bound, order[ranges(starts[place], size)], offsets(size)

    def decode_sql(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids, by an ordered aggregation."""
        n = np.diff(bounds)
        tokens = pa.table({"doc": np.repeat(np.arange(len(n)), n), "pos": np.arange(len(ids)), "tok": ids.astype(np.int64)})
        self.db.register("tokens", tokens)
        got = self.db.sql("SELECT doc, list(bytes ORDER BY pos) AS bytes FROM tokens JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc").to_arrow_table()
        self.db.unregister("tokens")
        out = np.full(len(n), b"", object)
        if got.num_rows:
            out[got["doc"].to_numpy()] = pc.binary_join(got["bytes"].combine_chunks().cast(pa.large_list(pa.large_binary())), pa.scalar(b"", pa.large_binary())).to_pylist()
        return out.tolist()


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path, pattern)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path, pattern)
        decimal = pa.array([str(k) for k in range(len(model.bytes))], pa.large_string())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        space = pa.scalar(" ", pa.large_string())
        for batch in slices(batches):
            ids, bound, order, rows = model.encode_chunks(as_text(batch.column("text")))
            at = pa.array(rows, pa.int64())
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bound, pa.int64()), decimal.take(pa.array(ids))), space)
            text = pc.binary_join(pa.LargeListArray.from_arrays(at, text.take(pa.array(order))), space).to_pylist()
            back = pa.array(model.decode_sql(ids, bound), pa.large_binary())
            back = pc.binary_join(pa.LargeListArray.from_arrays(at, back.take(pa.array(order))), pa.scalar(b"", pa.large_binary())).to_pylist()
            n = offsets(np.diff(bound)[order])[rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(n)), pa.array([sha(x.encode()) for x in text]), pa.array([sha(x) for x in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
