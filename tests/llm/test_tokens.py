"""Tokenizing, token output, byte-level BPE and packing."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public = pytest.importorskip("public_tokenizers")

from colonnade.llm import bpe, packing, token_output  # noqa: E402
from colonnade.llm.rangecoder import decode_blocks, encode_blocks  # noqa: E402
from colonnade.llm.wordbpe import word_bpe  # noqa: E402

WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_word_ids_equal_the_library(texts):
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    model = word_bpe(WORD)
    ids, at = model.encode(pa.array(texts, pa.large_string()))
    library = Tokenizer.from_file(WORD) if not hasattr(test_word_ids_equal_the_library, "lib") else test_word_ids_equal_the_library.lib
    test_word_ids_equal_the_library.lib = library
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_ids_equal_the_library_on_a_whole_table(library):
    import pyarrow.parquet as pq

    texts = ["" if t is None else t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    ids, at = word_bpe(WORD).encode(pa.array(texts, pa.large_string()))
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == want.ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_byte_ids_equal_the_library(texts):
    import tiktoken

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    model = bpe.byte_bpe(BYTE, public.PATTERN)
    f = test_byte_ids_equal_the_library
    f.lib = getattr(f, "lib", None) or tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    ids, at = model.encode(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == f.lib.encode_ordinary(t)
    assert [b.decode() for b in model.decode_sql(ids, at)] == texts


def wanted(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output(docs, rows, library):
    got = token_output.read_tokens(token_output.write_tokens(docs, WORD)).orderBy("start").collect()
    start = 0
    for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = wanted(library, text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_token_output_of_null_ids(spark, library):
    rows = [(None, "one text"), (3, "two"), (None, None), (3, "three"), (0, "four"), (-1, "five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_output.read_tokens(token_output.write_tokens(df, WORD)).orderBy("start").collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [(r["doc_id"], r["ids_crc32"]) for r in got] == [(d, crc(wanted(library, t))) for d, t in order]


def test_token_output_of_nothing(empty):
    assert token_output.read_tokens(token_output.write_tokens(empty, WORD)).count() == 0


@pytest.mark.parametrize("ids", [np.zeros((1, 50)), np.arange(300).reshape(3, 100) * 200 % 65536, np.random.default_rng(0).integers(0, 49408, (5, 700)), np.tile([7, 8, 9], (2, 200))])
def test_blocks_round_trip(ids):
    ids = ids.astype(np.int64)
    assert (decode_blocks(encode_blocks(ids), ids.shape[1]) == ids).all()


def test_blocks_stand_alone_and_compress():
    ids = np.random.default_rng(1).zipf(1.3, (4, 4096)) % 49408
    payloads = encode_blocks(ids)
    assert (decode_blocks(payloads[2:3], 4096) == ids[2:3]).all()
    assert sum(map(len, payloads)) < ids.size * 1.6


def test_a_broken_block_is_found():
    raw = bytearray(token_output.encode_record(np.array([1, 2]), np.array([3, 4]), np.arange(7)))
    for k in (20, len(raw) - 3):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            token_output.decode_record(bytes(bad))


def test_byte_bpe(docs, rows, tiktoken_encoding):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, BYTE, public.PATTERN).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        ids = tiktoken_encoding.encode_ordinary(text or "")
        want.add((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want


def test_byte_bpe_of_long_pieces(tiktoken_encoding):
    import random
    import time

    rng = random.Random(5)
    model = bpe.byte_bpe(BYTE, public.PATTERN)
    texts = ["x" * 5000, "ab" * 3000, *("".join(rng.choices("etaoinshrdlu", k=n)) for n in (100, 255, 256, 257, 4000)), "=" * 700]
    ids, at = model.encode(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tiktoken_encoding.encode_ordinary(t)
    began = time.time()
    whole = "".join(rng.choices("etaoinshrdlu", k=1 << 20))
    ids, _ = model.encode(pa.array([whole], pa.large_string()))
    assert time.time() - began < 60 and b"".join(model.bytes[k] for k in ids.tolist()).decode() == whole


def test_byte_bpe_of_nothing(empty):
    assert bpe.digests(empty, BYTE, public.PATTERN).count() == 0


def one_by_one(counts, window):
    """Best-fit decreasing, item by item: how full the windows are (ties between equal windows don't change that)."""
    open_, out = [], []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [k for k, room in enumerate(open_) if room >= s]
        k = min(fits, key=lambda k: open_[k]) if fits else len(open_)
        if not fits:
            open_.append(window)
            out.append([])
        open_[k] -= s
        out[k].append(s)
    return sorted(map(sum, out))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 9), max_size=10))
def test_runs_equal_the_packing_item_by_item(counts):
    runs, n = packing.best_fit_runs(counts, 16)
    windows = [[] for _ in range(n)]
    room = [0] * n
    for s, i0, i1, first, q, at in runs.tolist():
        for i in range(i0, i1):
            k, offset = first + (i - i0) // q, at + (i - i0) % q * s
            assert offset == room[k]
            room[k] += s
            windows[k].append(s)
    assert sorted(map(sum, windows)) == one_by_one(counts, 16) and Counter(s for w in windows for s in w) == +Counter(counts)


def test_packing(docs, rows, library):
    got = packing.pack_documents(docs, WORD).collect()
    ids = {}
    for doc_id, text, *_ in rows:
        ids[doc_id] = wanted(library, text)
    assert sum(r["length"] for r in got) == sum(len(wanted(library, r[1])) for r in rows)
    places = {}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and crc(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(places) == set(range(len(places)))
    tokens = sum(r["length"] for r in got)
    assert len(places) <= -(-tokens // 2048) + 1


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, WORD).count() == 0
