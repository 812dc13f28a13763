"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending order of identifier:

    block*  index  bloom  footer

block   zstd of entries: shared prefix length u8, suffix length u8, suffix, token count u32, ids
        (u16 or u32, as the shard says). Keys are 8 big-endian bytes of doc_id with the sign bit
        turned, so byte order is number order; a null doc_id has the empty key and comes first.
index   for each block: first key (length u8, bytes), offset u64, size u32, tokens before it u64
bloom   bits of a Bloom filter over the keys, BLOOM_BITS a key and BLOOM_HASHES probes
footer  offsets and sizes of index and bloom, documents, tokens, width of an id, magic

A lookup reads the footer, asks the Bloom filter, finds the block by binary search in the sparse
index and walks that block. Shards are written under names of their task attempt; only shards in
the manifest, which lists successful tasks, are read, so a lost executor leaves no wrong output.

Edge cases: a null text is empty (the end id alone); repeated doc_ids are neighbouring entries and
all come back from a lookup; an empty table gives no shard; a very long text is one entry of one
block, which is then as long. Columns other than doc_id and text take no part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shared_dir, small_batches
from .tokens import default_tokenizer, encoder

END_ID = 2
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"PWSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQI8s")
SHARD_BYTES = 256 << 20  # of UTF-8 text, which ids take less of
_MANIFEST = "shard int, path string, docs long, tokens long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def filesystem(uri: str):
    """(file system, path) of a URI in whatever store the shared folder is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes one shard from add(doc_id, ids) calls in key order."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.last, self.size = [], b"", 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.first, self.docs, self.tokens, self.before = b"", 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, self.tokens
        n = len(ids) // 4
        body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        entry = bytes((shared, len(key) - shared)) + key[shared:] + struct.pack("<I", n) + body
        self.block.append(entry)
        self.size += len(entry)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.docs, self.tokens = key, self.docs + 1, self.tokens + n
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.out.write(data)
            self.index.append(bytes((len(self.first),)) + self.first + struct.pack("<QIQ", self.at, len(data), self.before))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        bits = max(8, -(-BLOOM_BITS * len(self.keys) // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.width, MAGIC))
        self.at += len(index) + len(bloom) + FOOTER.size
        self.out.close()


class Reader:
    """Random access to one shard: scan() in order, get(doc_id) by Bloom filter and binary search."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.f = store.open_input_file(path)
        end = self.f.size()
        at, n, b_at, b_n, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self.f.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of this format")
        index = self.f.read_at(n, at)
        self.bloom = self.f.read_at(b_n, b_at)
        self.firsts, self.blocks, k = [], [], 0
        while k < n:
            size = index[k]
            self.firsts.append(index[k + 1 : k + 1 + size])
            self.blocks.append(struct.unpack_from("<QIQ", index, k + 1 + size))
            k += 1 + size + 20

    def entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, tokens of the shard before it, ids as uint32 bytes) of one block."""
        import zstandard

        at, n, start = self.blocks[block]
        data, k, key = zstandard.ZstdDecompressor().decompress(self.f.read_at(n, at)), 0, b""
        while k < len(data):
            shared, rest = data[k], data[k + 1]
            key = key[:shared] + data[k + 2 : k + 2 + rest]
            k += 2 + rest
            (count,) = struct.unpack_from("<I", data, k)
            body = data[k + 4 : k + 4 + count * self.width]
            k += 4 + count * self.width
            yield key, start, np.frombuffer(body, "<u2").astype("<u4").tobytes() if self.width == 2 else body
            start += count

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        for b in range(len(self.blocks)):
            for key, start, ids in self.entries(b):
                yield id_of(key), start, ids

    def get(self, doc_id: int | None) -> list[bytes]:
        key = key_of(doc_id)
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        # Equal keys may run over several blocks: start before the first block that begins with key.
        from bisect import bisect_left

        found = []
        for b in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            found += [ids for k, _, ids in self.entries(b) if k == key]
        return found


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Write docs(doc_id, text) as shards under folder; returns the manifest, one entry a shard, in key order.

    Rows are ranged by (doc_id, hash of text), so repeated doc_ids may be split; text and not ids
    are shuffled. The manifest has as many rows as there are shards: one for SHARD_BYTES of text,
    and as many as the session has shuffle partitions at least.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        writer = path = None
        enc = encoder(tokenizer)
        enc.clear()
        width = 2 if max(enc.library.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        part = TaskContext.get().partitionId()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if writer is None:
                    path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
                    store, local = filesystem(path)
                    store.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    writer = Writer(store.open_output_stream(local), width)
                writer.add(doc, enc.encode(text.as_py() or "") + end)
        enc.clear()
        if writer is not None:
            writer.close()
            cols = [pa.array([x], t) for x, t in ((part, pa.int32()), (path, pa.string()), (writer.docs, pa.int64()), (writer.tokens, pa.int64()), (writer.at, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "path", "docs", "tokens", "bytes"])

    n = shards or _shards(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    with small_batches(spark):
        listed = ranged.select("doc_id", "text").mapInArrow(lean(run), _MANIFEST).collect()
    return [r.asDict() for r in sorted(listed, key=lambda r: r["shard"])]


def _shards(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(-(-size // SHARD_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def read(spark, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards, each shard read by one task."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], fields)
    before, rows = 0, []
    for m in manifest:
        rows.append((m["path"], before))
        before += m["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields.split(", ")]
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = [(d, first + s, len(ids) // 4, zlib.crc32(ids)) for d, s, ids in Reader(path).scan()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    listed = spark.createDataFrame(rows, "path string, first long").repartition(len(rows))
    return listed.mapInArrow(lean(run), fields)


def write_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, shared_dir(spark), tokenizer, end_id))
