"""Token ids as binary shards of patched frame-of-reference blocks.

A shard file holds whole documents in ascending order. Its ids are cut into blocks of BLOCK. A block
keeps its minimum, the rest packed at a width that holds QUANTILE of the block, and a list of
exceptions (place, value above the minimum) for the others. The block index has the start, minimum,
width and number of exceptions of each block, so that any block can be read alone.

File: magic; header (block size, ids, documents, blocks, partition, ids of the partition before this
shard); document ids; flags of null ids; document lengths; block index; payload; CRC-32 of all before.
All numbers are little-endian.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import bounded, ddl, scratch, shuffle_partitions, written

MAGIC = b"PFORTOK1"
HEADER = struct.Struct("<IQQQQQ")
INDEX = np.dtype([("start", "<u8"), ("base", "<u4"), ("exceptions", "<u2"), ("width", "u1")])
EXCEPTION = np.dtype([("place", "<u2"), ("value", "<u4")])
BLOCK = 256
QUANTILE = 0.9
SHARD_IDS = 2_000_000
END = 2
SHARD = pa.schema([(c, pa.int64()) for c in ("partition", "shard", "docs", "ids")])
CACHE = 150_000  # chunks whose ids a worker keeps
AFTER_LETTER = r"([a-z])([!-/:-@\[-`{-~])"

_tokenizers: dict[str, tuple] = {}


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def pack(ids: np.ndarray, block: int = BLOCK, quantile: float = QUANTILE) -> tuple[np.ndarray, bytes]:
    """Block index and payload of ``ids`` (unsigned 32-bit)."""
    n = -(-len(ids) // block)
    index = np.zeros(n, INDEX)
    payload, at = [], 0
    for first in range(0, n, 1024):
        some = ids[first * block : (first + 1024) * block].astype(np.uint32)
        fill = -len(some) % block
        x = np.concatenate([some, np.full(fill, some[-1], np.uint32)]).reshape(-1, block)
        base = x.min(axis=1)
        x = x - base[:, None]
        k = min(block - 1, int(quantile * block))
        width = np.ceil(np.log2(np.partition(x, k, axis=1)[:, k].astype(np.float64) + 1)).astype(np.int64)
        over = x > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
        body: list[bytes] = [b""] * len(x)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            if w:
                for r, p in zip(rows.tolist(), _packed(x[rows] & np.uint32((1 << w) - 1), w)):
                    body[r] = p.tobytes()
        count = over.sum(axis=1)
        row, place = np.nonzero(over)
        extra = np.zeros(len(row), EXCEPTION)
        extra["place"], extra["value"] = place, x[row, place]
        cuts = np.r_[0, np.cumsum(count)]
        for r in range(len(x)):
            index[first + r] = (at, base[r], count[r], width[r])
            piece = body[r] + extra[cuts[r] : cuts[r + 1]].tobytes()
            payload.append(piece)
            at += len(piece)
    return index, b"".join(payload)


def unpack(index: np.ndarray, payload: bytes, n: int, block: int = BLOCK) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    out = np.empty((len(index), block), np.uint32)
    for first in range(0, len(index), 1024):
        part = index[first : first + 1024]
        here = out[first : first + 1024]
        start = part["start"].astype(np.int64)
        for w in np.unique(part["width"]).tolist():
            rows = np.flatnonzero(part["width"] == w)
            if not w:
                here[rows] = 0
                continue
            size = block * w // 8
            bits = np.unpackbits(raw[start[rows][:, None] + np.arange(size)], axis=1, bitorder="little").reshape(-1, block, w)
            wide = np.zeros((len(rows), block, 32), np.uint8)
            wide[:, :, :w] = bits
            here[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
        body = start + block * part["width"].astype(np.int64) // 8
        for r in np.flatnonzero(part["exceptions"]).tolist():
            extra = np.frombuffer(payload, EXCEPTION, int(part["exceptions"][r]), int(body[r]))
            here[r, extra["place"]] = extra["value"]
        here += part["base"][:, None]
    return out.ravel()[:n]


def shard_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, partition: int, before: int) -> bytes:
    index, payload = pack(ids)
    body = b"".join([
        MAGIC, HEADER.pack(BLOCK, len(ids), len(doc_ids), len(index), partition, before),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u8").tobytes(), index.tobytes(), payload,
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def read_shard(raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int, int]:
    """Document ids, their lengths, all ids, the partition and the ids before; ValueError if damaged."""
    if raw[:8] != MAGIC or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not an intact token shard")
    block, n, docs, blocks, partition, before = HEADER.unpack_from(raw, 8)
    at = 8 + HEADER.size
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    null = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(raw, "<u8", docs, at := at + docs).astype(np.int64)
    index = np.frombuffer(raw, INDEX, blocks, at := at + 8 * docs)
    ids = unpack(index, raw[at + INDEX.itemsize * blocks : -4], n, block)
    return [None if x else d for d, x in zip(doc_ids, null)], lengths, ids, partition, before


def read_block(raw: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, through the block index."""
    block, n, docs, blocks, _, _ = HEADER.unpack_from(raw, 8)
    at = 8 + HEADER.size + 17 * docs
    index = np.frombuffer(raw, INDEX, blocks, at)[k : k + 1]
    return unpack(index, raw[at + INDEX.itemsize * blocks : -4], min(block, n - k * block), block)


class Encoder:
    """Ids of texts, put together from chunks between white space.

    The tokenizer drops white space and never joins what stands on two sides of it, nor a letter with
    the punctuation after it; it lower-cases character by character. So a text's ids are those of its
    lower-cased chunks in a row, also with a space set between a letter and ASCII punctuation. Texts
    that may hold a special token go to the tokenizer as they are. Arrow finds the distinct chunks of
    a batch; each worker keeps the ids of the first CACHE chunks that it meets.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        out = {}
        one = [p for p in chunks if p.isascii() and p.isalpha()]  # each is one word, so many go into one call
        for i in range(0, len(one), 16384):
            part = one[i : i + 16384]
            lines = [" ".join(part[k : k + 64]) for k in range(0, len(part), 64)]
            got = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.array([x for e in got for x in e.ids], "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't mark where words end")
            out.update((p, raw[s:e]) for p, s, e in zip(part, [0, *ends], ends))
        rest = [p for p in chunks if p not in out]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                out[p] = np.array(e.ids, "<u4").tobytes()
        return out

    def _ids(self, chunks: list[str]) -> list[bytes]:
        known = self.known
        blobs = [known.get(c) for c in chunks]
        new = self._encode([c for c, b in zip(chunks, blobs) if b is None])
        if len(known) < CACHE:
            known |= new
        return [new[c] if b is None else b for c, b in zip(chunks, blobs)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = pc.match_substring(texts, "<|")
        plain = pc.replace_substring_regex(pc.ascii_lower(pc.if_else(special, "", texts)), AFTER_LETTER, r"\1 \2")
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        blobs = self._ids(coded.dictionary.to_pylist())
        ends = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs))) // 4
        table = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), np.frombuffer(b"".join(blobs), "<u4"))
        ids = table.take(coded.indices)
        cuts = np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
        cuts = ids.offsets.to_numpy()[cuts] - ids.offsets[0].as_py()
        ids, n = ids.flatten().to_numpy(), np.diff(cuts)
        if odd := np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            parts = np.split(ids, cuts[1:-1])
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, n = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, n


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def write(docs: DataFrame, folder: str, tokenizer: str, partitions: int | None = None) -> DataFrame:
    """Write shards in ascending doc_id order below ``folder``; returns their manifest, already made.

    Documents are dealt by ranges of doc_id, so partitions follow one another; each task cuts its run
    into shards of about SHARD_IDS ids. A shard gets its final name only when it is whole, and that
    name depends on the partition alone: a task that runs again puts the same file in its place.
    Null ids come first; rows that repeat an id keep their texts' order. Null texts have only the end
    id. Any folder that pyarrow can write to will do.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)

    end = np.array([END], np.uint32)

    def run(batches):
        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path, recursive=True)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, lengths, blobs, size = [], [], [], 0

        def flush():
            nonlocal seq, before, ids, lengths, blobs, size
            raw = shard_bytes(ids, lengths, np.concatenate(blobs), part, before)
            name = f"{path}/part-{part:06d}-{seq:05d}.pfor"
            with place.open_output_stream(temporary := f"{name}.{uuid.uuid4().hex}.tmp") as f:
                f.write(raw)
            place.move(temporary, name)
            row = pa.RecordBatch.from_pydict({"partition": [part], "shard": [seq], "docs": [len(ids)], "ids": [size]}, SHARD)
            seq, before = seq + 1, before + size
            ids, lengths, blobs, size = [], [], [], 0
            return row

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x = b.slice(at, 2000)
                got, n = encoder(tokenizer)(x.column("text"))
                ends = np.cumsum(n)
                for d, s, e in zip(x.column("doc_id").to_pylist(), (ends - n).tolist(), ends.tolist()):
                    ids.append(d)
                    blobs.append(got[s:e])
                    blobs.append(end)
                    lengths.append(e - s + 1)
                    size += e - s + 1
                    if size >= SHARD_IDS:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(bounded(rows).mapInArrow(run, "partition long, shard long, docs long, ids long"), "manifest")


def read(manifest: DataFrame, folder: str, doc_id: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the shard files."""
    spark = manifest.sparkSession
    totals = manifest.groupBy("partition").agg(F.sum("ids").alias("ids"))  # one row for each partition
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("partition", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for raw in b.column("content"):
                doc_ids, lengths, ids, partition, first = read_shard(raw.as_py())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = (doc_ids, ends - lengths + first, lengths, crc, np.full(len(ends), partition))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "at", "n_tokens", "ids_crc32", "partition"])

    if not manifest.head(1):
        return spark.createDataFrame([], f"doc_id {doc_id}, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("content")
    rows = files.mapInArrow(run, "doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, partition bigint")
    start = (F.col("at") + F.col("base")).alias("start")
    return rows.join(bases, "partition").select(F.col("doc_id").cast(doc_id).alias("doc_id"), start, "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer: str, partitions: int | None = None) -> DataFrame:
    """Write all documents as token shards into the shared folder, and read them back; one row each."""
    folder = scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer, partitions), folder, ddl(docs, "doc_id"))
