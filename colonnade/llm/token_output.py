"""Token ids as files of independently decodable, checksummed range-coded blocks.

A file is a Parquet file of records in ascending order of document id; a record
is the ids of whole documents in the binary layout below, so records are written
and read by Spark's own writers in any store and a lost task is written again.

record: magic "CMR2", u32 documents, u64 ids, u32 ids a block, u32 blocks,
u32 crc32 of these and the table; table: i64 document ids, u32 id counts, a bit
for each document id that isn't null (zlib), then for each block u32 bytes, u32 crc32 of its payload, u32 crc32 of its ids; payloads.
Every block has reset models; a record's ids are dealt to blocks of equal length,
the last padded with id 0.

Defined results: a null text is empty; null document ids come first and stay null; an empty document is its end id alone;
repeated rows are written as often as they occur, rows of one doc_id in the
order of their texts; an empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from colonnade.llm.columns import as_text, offsets, slices
from colonnade.llm.rangecoder import decode_blocks, encode_blocks
from colonnade.llm.sparkio import stored
from colonnade.llm.wordbpe import word_bpe

#: the most ids in a block
BLOCK = 1 << 18
#: bytes of text in a record; the more blocks are coded in step, the less each id costs
RECORD_BYTES = 18 << 20
HEAD = struct.Struct("<4sIQIII")


def _check(fields: tuple, table: bytes) -> int:
    return zlib.crc32(table, zlib.crc32(HEAD.pack(*fields, 0)))


def encode_record(doc_ids: np.ndarray | pa.Array, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    n = -(-len(ids) // block)
    block = -(-len(ids) // max(n, 1))
    padded = np.zeros(n * block, np.int64)
    padded[: len(ids)] = ids
    payloads = encode_blocks(padded.reshape(n, block)) if n else []
    sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in padded.reshape(n, block)]
    doc_ids = pa.array(doc_ids, pa.int64())
    known = np.packbits(doc_ids.is_valid().to_numpy(zero_copy_only=False))
    table = zlib.compress(pc.fill_null(doc_ids, 0).to_numpy().astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + known.tobytes())
    table += b"".join(struct.pack("<III", len(p), zlib.crc32(p), c) for p, c in zip(payloads, sums))
    fields = (b"CMR2", len(doc_ids), len(ids), block, n)
    head = HEAD.pack(*fields, _check(fields, table))
    return b"".join([head, struct.pack("<I", len(table)), table, *payloads])


def decode_record(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, lengths, ids; raises ValueError where a checksum fails."""
    magic, docs, total, block, n, check = HEAD.unpack_from(raw)
    (size,) = struct.unpack_from("<I", raw, HEAD.size)
    at = HEAD.size + 4
    table = raw[at : at + size]
    if magic != b"CMR2" or _check((magic, docs, total, block, n), table) != check:
        raise ValueError("not an intact record of token blocks")
    marks = np.frombuffer(table[size - 12 * n :], "<u4").reshape(n, 3) if n else np.zeros((0, 3), np.uint32)
    plain = zlib.decompress(table[: size - 12 * n])
    ends = at + size + offsets(marks[:, 0].astype(np.int64))
    payloads = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    for k, p in enumerate(payloads):
        if zlib.crc32(p) != marks[k, 1]:
            raise ValueError(f"block {k}: its bytes fail their checksum")
    ids = decode_blocks(payloads, block) if n else np.zeros((0, block), np.int64)
    for k, x in enumerate(ids):
        if zlib.crc32(x.astype("<u4").tobytes()) != marks[k, 2]:
            raise ValueError(f"block {k}: its ids fail their checksum")
    known = np.unpackbits(np.frombuffer(plain[12 * docs :], np.uint8), count=docs).astype(bool)
    doc_ids = pa.array(np.frombuffer(plain[: 8 * docs], "<i8"), mask=~known)
    return doc_ids, np.frombuffer(plain[8 * docs : 12 * docs], "<u4").astype(np.int64), ids.reshape(-1)[:total]


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, parts: int | None = None) -> DataFrame:
    """Writes the table's ids; returns the files' records (part, record, payload) as read back."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, part, record = word_bpe(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, RECORD_BYTES):
            ids, bounds = model.encode(as_text(batch.column("text")))
            wide = np.insert(ids.astype(np.int64), bounds[1:], end_id)
            n = np.diff(bounds) + 1
            raw = encode_record(batch.column("doc_id"), n, wide)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([record], pa.int32()), pa.array([len(wide)], pa.int64()), pa.array([raw])], ["part", "record", "n_ids", "payload"])
            record += 1

    return stored(texts.mapInArrow(run, "part int, record int, n_ids long, payload binary"), "tokens", compression="uncompressed")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files."""
    whole = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each partition that was written
    before = whole.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("__part_start"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("record")) - F.col("n_ids")
    starts = files.select("part", "record", "n_ids").withColumn("__in", inside).join(F.broadcast(before), "part")
    starts = starts.select("part", "record", (F.col("__in") + F.col("__part_start")).alias("__start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, record, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "record", "payload"))):
                doc, n, ids = decode_record(raw)
                at = offsets(n)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                size = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, part, np.int32)), pa.array(np.full(size, record, np.int32)), doc, pa.array(at[:-1]), pa.array(n), pa.array(crc, pa.int64())], ["part", "record", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = files.select("part", "record", "payload").mapInArrow(run, "part int, record int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row for each record: what is broadcast is under a millionth of the texts
    out = read.join(starts, ["part", "record"])
    return out.select("doc_id", (F.col("at") + F.col("__start")).alias("start"), "n_tokens", "ids_crc32")
