import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm import alignment as al
from llm import common

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=FILES[1])


def plain_groups(library, text):
    """Cut where both sides' tokens end, by their byte offsets."""
    a, b = library
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    if not text:
        return []
    first = a.encode(" " + text, add_special_tokens=False)
    own_a = [bytes(byte[c] for c in t) for t in first.tokens]
    second = b.encode(text)
    own_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(second, map(b.id_to_piece, second))]
    if not b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
        return []
    ends = [{sum(map(len, own[: k + 1])) for k in range(len(own))} for own in (own_a, own_b)]
    out, at = [], 0
    for end in sorted(ends[0] & ends[1]):
        pick = lambda ids, own: [i for k, i in enumerate(ids) if at < sum(map(len, own[: k + 1])) <= end]  # noqa: B023, E731
        out.append((pick(first.ids, own_a), pick(second, own_b)))
        at = end
    return out


def plain(library, texts):
    found = [plain_groups(library, t) for t in texts]
    linked = [[(x, y) for p, q in g for x in p for y in q] for g in found]
    df, most = {}, {}
    for links in linked:
        for pair in set(links):
            df[pair] = df.get(pair, 0) + 1
    for (x, _), n in df.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for g, links in zip(found, linked):
        line = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
        out.append((
            sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(links), sum(df[x] == most[x[0]] for x in links), sum(df[x] for x in links),
            hashlib.sha256(line.encode()).hexdigest() if g else "",
        ))
    return out


def odd_texts():
    rnd = random.Random(4)
    letters = [*"abc  \n\tE.,'\u00e9\u6f22\u2581\u00a0\U0001f600\x00\r01_<>|", "ing", " the", "\r\n", "</s>", "<0x41>", "<|endoftext|>", "  ", "'s", "\u0301"]
    return ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(150)]


def test_report_matches_brute_force(spark, library):
    docs = [x for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if x]
    texts = [x[:400] for x in docs[:120]] + odd_texts() + [None, "", " ", "a" * 900, " " * 700, docs[0][:400], docs[0][:400], "\u2581x"]
    rows = [(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string, pair int").repartition(6)
    got = al.report(df, *FILES).collect()
    want = plain(library, texts)
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(((k if k % 9 else None, *w) for k, w in enumerate(want)), key=key)
    lines = {r.doc_id: r.groups for r in al.groups(df, *FILES).collect() if r.doc_id}
    assert all(hashlib.sha256(lines[r.doc_id].encode()).hexdigest() == r.groups_sha256 or not r.n_a for r in got if r.doc_id)
    pairs = al.pair_counts(df, *FILES).collect()
    assert max(p["count"] for p in pairs) <= len(texts) and sum(p.best for p in pairs) >= len({p.a for p in pairs})


def test_fast_encoder_gives_the_library_ids(library):
    own = al.aligner(*FILES)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() + odd_texts() + ["a" * 9000, " " * 9000, "\n" * 3000, "ab\n" * 3000]
    for t in texts:
        assert own.first(" " + (t or "")) == library[0].encode(" " + (t or ""), add_special_tokens=False).ids


def test_transducer_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(al, "MEMO", 3)
    rnd = random.Random(6)
    vocabulary = [b"a", b"b", b"ab", b"ba", b"aab", b"bb", b"aba"]
    for _ in range(300):
        pair = al.Pair(vocabulary, vocabulary)
        x, y = ([rnd.randrange(len(vocabulary)) for _ in range(rnd.randint(0, 8))] for _ in range(2))
        if rnd.random() < 0.5:  # another way to spell x
            y, text = [], b"".join(vocabulary[k] for k in x)
            while text:
                k = rnd.choice([k for k, v in enumerate(vocabulary) if text.startswith(v)])
                y, text = [*y, k], text[len(vocabulary[k]) :]
        spell = lambda ids: [len(b"".join(vocabulary[k] for k in ids[: i + 1])) for i in range(len(ids))]
        same = b"".join(vocabulary[k] for k in x) == b"".join(vocabulary[k] for k in y)
        ends = pair.ends(x, y)
        assert (ends is not None) == same
        if same:
            both = sorted(set(spell(x)) & set(spell(y)))
            assert ends == ([spell(x).index(e) + 1 for e in both], [spell(y).index(e) + 1 for e in both])


def test_wide_groups_count_equal_ids_first(monkeypatch):
    own = al.aligner(*FILES)
    texts = odd_texts() + ["a" * 500]
    count = lambda: {}
    def summed():
        out = count()
        for t, p, n in zip(*(x.tolist() for x in own.groups(texts).links())):
            out[t, p] = out.get((t, p), 0) + n
        return out
    narrow = summed()
    monkeypatch.setattr(al, "WIDE", 2)
    assert summed() == narrow


def test_empty(spark):
    assert al.report(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect() == []


def test_batches_are_written_a_few_at_a_time(spark, monkeypatch):
    """Writers and readers hold a row group, so its rows mustn't be all batches of a task."""
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 14)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setitem(al.LARGE_ROWS, "parquet.block.size", str(1 << 16))
    files = [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")).metadata for f in al._batches(docs, *FILES).inputFiles()]
    rows = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(rows) >= 8 and max(rows) <= 3


def test_told_counts_come_back_in_order(spark):
    rows = [(b, i, 10 * b + i, i % 3 == 0) for b in range(40) for i in range(b % 7 + 1)]
    got = al._told(spark.createDataFrame(rows, "batch long, i int, count long, best boolean").repartition(3)).collect()
    assert len(got) == 40
    for r in got:
        want = [x[2:] for x in rows if x[0] == r.batch]
        assert [*zip(np.frombuffer(r.counts, "<i8").tolist(), np.frombuffer(r.bests, bool).tolist())] == want
