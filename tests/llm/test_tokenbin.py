import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm import tokenbin as t

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=900), st.sampled_from([8, 256]))
def test_blocks_round_trip(ids, block):
    x = np.array(ids, np.uint32)
    index, payload = t.pack(x, block)
    assert t.unpack(index, payload, len(x), block).tolist() == ids


def test_shard_and_single_block():
    ids = np.random.default_rng(0).integers(0, 50_000, 1000).astype(np.uint32)
    ids[5] = 2**32 - 1
    raw = t.shard_bytes([3, None, 9], [400, 0, 600], ids, 7, 11)
    doc_ids, lengths, back, part, before = t.read_shard(raw)
    assert (doc_ids, lengths.tolist(), back.tolist(), part, before) == ([3, None, 9], [400, 0, 600], ids.tolist(), 7, 11)
    assert [x for k in range(4) for x in t.read_block(raw, k).tolist()] == ids.tolist()
    with pytest.raises(ValueError):
        t.read_shard(raw[:100] + b"x" + raw[101:])


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aAB'sé%²½ 1\n\t\r\x0b\x1c\x85  ́日ΣΣ.,-İ<|endoftext|>"), max_size=60))
def test_chunks_give_the_ids_of_whole_texts(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    ids, n = t.encoder(PATH)(pa.array([text, None, "it"]))
    assert ids[: n[0]].tolist() == whole and n[1:].tolist() == [0, 1]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(t, "SHARD_IDS", 100)
    rows = [(i * 7 % 101, f"Text number {i}, it's here " * (i % 9), "x") for i in range(101)]
    rows += [(500, None, "x"), (501, "", "x"), (502, "long " * 30_000, "x"), (7, "repeated", "x"), (None, "no id", "x")]
    out = t.encode(spark.createDataFrame(rows, "doc_id long, text string, start string"), PATH, 5).collect()
    plain, start, expect = Tokenizer.from_file(PATH), 0, []
    for d, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        expect.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == [(s, d, n, c) for d, s, n, c in expect]


def test_empty(spark):
    assert t.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
