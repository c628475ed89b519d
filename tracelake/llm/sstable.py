"""Token ids in sorted-string-table shards, keyed by document identifier.

A shard file is a run of data blocks, a sparse index, a Bloom filter and a
footer, all integers little-endian:

* entry: shared prefix and suffix length of the key (2 bytes each), number of
  ids (4 bytes), key suffix, ids.  A block starts with a whole key.
* index: for each block its first key (length 2 bytes, bytes), offset and
  length (8 bytes each), entries (4 bytes), and ids of the shard before it (8).
* filter: bits for the keys; the footer has their number.
* footer: the struct ``_FOOTER``, at the end of the file.

A key is the identifier as 8 big-endian bytes with the sign bit turned, which
sort as the numbers do; a null identifier has the empty key and comes first.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix
from .common import fresh_path
from .tokens import encoder

BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_ENTRY = struct.Struct("<HHI")
_INDEX = struct.Struct("<QQIQ")
#: index offset and length, filter offset and bits, documents, ids, bytes of an id, magic
_FOOTER = struct.Struct("<QQQQQQI8s")
_MAGIC = b"TLSST001"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    """Bits of each key by double hashing; ``bits`` is a power of two."""
    value = np.array([int.from_bytes(k, "big") + len(k) for k in keys], dtype=object)
    one = mix(np.array([int(v) & (1 << 64) - 1 for v in value], dtype=np.uint64))
    two = mix(one ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (one[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * two[:, None]) & np.uint64(bits - 1)


class ShardWriter:
    """Writes one shard; entries must come in the order of their keys."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width
        self.fs, self.name = _open(path)
        self.part = f"{self.name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.out = self.fs.open_output_stream(self.part)
        self.block, self.block_bytes, self.last, self.first = [], 0, b"", b""
        self.index, self.keys, self.at, self.ids = [], [], 0, 0
        self.before = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, self.ids
        n = len(ids) // self.width
        entry = _ENTRY.pack(shared, len(key) - shared, n) + key[shared:] + ids
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.last = key
        self.ids += n
        self.keys.append(key)

    def _flush(self) -> None:
        if self.block:
            self.out.write(b"".join(self.block))
            self.index.append((self.first, self.at, self.block_bytes, len(self.block), self.before))
            self.at += self.block_bytes
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + _INDEX.pack(*rest) for k, *rest in self.index)
        bits = 64
        while bits < BLOOM_BITS * len(self.keys):
            bits *= 2
        bloom = np.zeros(bits, dtype=np.uint8)
        for start in range(0, len(self.keys), 100_000):
            bloom[_bloom_places(self.keys[start : start + 100_000], bits).ravel()] = 1
        self.out.write(index)
        self.out.write(np.packbits(bloom, bitorder="little").tobytes())
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.ids, self.width, _MAGIC))
        self.out.close()
        self.fs.move(self.part, self.name)  # a retried task replaces the same file


class ShardReader:
    """Reads a shard whole, block by block, or looks a single key up."""

    def __init__(self, path: str):
        self.fs, self.name = _open(path)
        self.file = self.fs.open_input_file(self.name)
        end = self.file.size()
        footer = self.file.read_at(_FOOTER.size, end - _FOOTER.size)
        at, size, self.bloom_at, self.bits, self.docs, self.ids, self.width, magic = _FOOTER.unpack(footer)
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a shard")
        raw, self.index, place = bytes(self.file.read_at(size, at)), [], 0
        while place < size:
            (n,) = struct.unpack_from("<H", raw, place)
            key = raw[place + 2 : place + 2 + n]
            self.index.append((key, *_INDEX.unpack_from(raw, place + 2 + n)))
            place += 2 + n + _INDEX.size
        self.firsts = [x[0] for x in self.index]

    def entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before it, ids) of a block."""
        _, at, size, count, before = self.index[block]
        raw, place, key = bytes(self.file.read_at(size, at)), 0, b""
        for _ in range(count):
            shared, more, n = _ENTRY.unpack_from(raw, place)
            place += _ENTRY.size
            key = key[:shared] + raw[place : place + more]
            place += more
            yield key, before, raw[place : place + n * self.width]
            place += n * self.width
            before += n

    def may_hold(self, key: bytes) -> bool:
        for bit in _bloom_places([key], self.bits)[0]:
            byte = self.file.read_at(1, self.bloom_at + int(bit) // 8)[0]
            if not byte >> int(bit) % 8 & 1:
                return False
        return True

    def get(self, key: bytes) -> list[bytes]:
        """Ids of all entries of the key, by filter, binary search and one or more blocks."""
        if not self.index or not self.may_hold(key):
            return []
        found = []
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.index) and self.firsts[block] <= key:
            found += [ids for k, _, ids in self.entries(block) if k == key]
            block += 1
        return found


def write_token_table(
    docs: DataFrame, vocabulary: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, vocabulary_size: int = 50257
) -> list[dict]:
    """Encode whole texts and write them as shards under ``path``, in ascending order of the id.

    Returns one row for each shard: its file, first and last key, documents and
    ids.  A null text is empty, a null id comes first, repeated ids keep all of
    their rows in a fixed order, and an empty table gives no shard.  Rows are
    dealt by (id, hash of text), so that an id with very many rows is split.
    """
    width = 2 if vocabulary_size <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, out, name, first = encoder(vocabulary), None, "", None
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    name = f"shard-{shard:06d}.sst"
                    out, first = ShardWriter(f"{path}/{name}", width), doc_id
                ids = np.frombuffer(pieces.encode(text) + tail, dtype="<u4")
                out.add(key_of(doc_id), ids.astype(kind).tobytes())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [name], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([id_of(out.last)], pa.int64()), "docs": [len(out.keys)], "ids": [out.ids]}
            )

    _open(path)[0].create_dir(_open(path)[1], recursive=True)
    made = rows.mapInArrow(write, "shard long, file string, first_id long, last_id long, docs long, ids long").collect()
    return [r.asDict() for r in sorted(made, key=lambda r: r["shard"])]


def read_token_table(spark: SparkSession, path: str, shards: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, read from the files.

    One task reads one shard, a block at a time; ``shards`` is what the writer returned.
    """
    base, before = [], 0
    for s in shards:
        base.append((f"{path}/{s['file']}", before))
        before += s["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                name, start = base[n]
                shard = ShardReader(name)
                kind = "<u2" if shard.width == 2 else "<u4"
                for block in range(len(shard.index)):
                    rows = list(shard.entries(block))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([id_of(k) for k, _, _ in rows], pa.int64()),
                            "start": pa.array([start + b for _, b, _ in rows], pa.int64()),
                            "n_tokens": pa.array([len(v) // shard.width for _, _, v in rows], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(np.frombuffer(v, kind).astype("<u4").tobytes()) for _, _, v in rows], pa.int64()),
                        }
                    )

    return spark.range(0, len(base), 1, max(1, len(base))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(path: str, shards: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document, by binary search over shards, index and block."""
    key, found = key_of(doc_id), []
    for s in shards:
        if key_of(s["first_id"]) <= key <= key_of(s["last_id"]):
            reader = ShardReader(f"{path}/{s['file']}")
            found += [np.frombuffer(v, "<u2" if reader.width == 2 else "<u4") for v in reader.get(key)]
    return found


def token_table(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the shards in the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    return read_token_table(docs.sparkSession, path, write_token_table(docs, vocabulary, path, **options))
