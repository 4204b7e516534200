"""Token ids of a corpus as binary files of patched frame-of-reference blocks.

A file holds blocks of ids, an index of block starts, and a table of its documents. A block stores its minimum, packs
what is above it at the width that a percentile of its values needs, and lists the high bits of the outliers apart.
Any document can be read alone through the index.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from placegrid.llm.common import batches_of, exclusive_offsets, open_file, put_file, shared_folder
from placegrid.llm.tokens import coder, word_bpe_path
from placegrid.session import materialize

BLOCK = 512
PERCENTILE = 0.95
_MAGIC = b"PFOR0001"
_HEAD = struct.Struct("<IBHH")      # minimum, width, exceptions, values
_FOOT = struct.Struct("<QQQQQ8s")   # ids, blocks, documents, index start, table start, magic


def _put_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, end to end, a row of bytes for each row of values."""
    kind = "<u2" if width <= 16 else "<u4"
    raw = values.astype(kind).view(np.uint8).reshape(len(values), -1)
    if width == 8 * np.dtype(kind).itemsize:
        return raw
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(*values.shape, -1)[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _get_bits(raw: np.ndarray, width: int, count: int) -> np.ndarray:
    kind = "<u2" if width <= 16 else "<u4"
    full = 8 * np.dtype(kind).itemsize
    if width < full:
        bits = np.zeros((len(raw), count, full), np.uint8)
        bits[:, :, :width] = np.unpackbits(raw, axis=1, count=width * count, bitorder="little").reshape(len(raw), count, width)
        raw = np.packbits(bits.reshape(len(raw), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(kind).astype(np.uint32)


def pack_blocks(ids: np.ndarray, size: int = BLOCK) -> list[bytes]:
    """Blocks of ``size`` ids each; the last may be shorter."""
    out: list[bytes] = []
    whole = len(ids) // size * size
    parts = [ids[:whole].reshape(-1, size)] + ([ids[whole:].reshape(1, -1)] if whole < len(ids) else [])
    for rows in parts:
        if not rows.size:
            continue
        low = rows.min(axis=1)
        above = (rows - low[:, None]).astype(np.uint32)
        k = int(np.ceil(PERCENTILE * (rows.shape[1] - 1)))
        width = np.frexp(np.partition(above, k, axis=1)[:, k].astype(np.float64))[1]
        packed: list[bytes | None] = [None] * len(rows)
        for w in map(int, np.unique(width)):
            chosen = np.flatnonzero(width == w)
            flat = _put_bits(above[chosen], w)
            high = above[chosen] >> np.uint32(w) if w < 32 else np.zeros_like(above[chosen])
            block_of, at = np.nonzero(high)
            outliers, cut = high[block_of, at].astype("<u4"), np.searchsorted(block_of, np.arange(len(chosen) + 1))
            for k, row in enumerate(chosen):
                a, b = cut[k], cut[k + 1]
                packed[row] = b"".join((_HEAD.pack(int(low[row]), w, b - a, rows.shape[1]), flat[k].tobytes(),
                                        at[a:b].astype("<u2").tobytes(), outliers[a:b].tobytes()))
        out += packed
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks; ``starts`` are their places in ``data``. Blocks alike in shape are unpacked together."""
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    ends = np.cumsum(np.array([h[3] for h in heads], np.int64))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (_, w, _, n) in enumerate(heads):
        shapes.setdefault((w, n), []).append(k)
    raw = np.frombuffer(data, np.uint8)
    for (w, n), blocks in shapes.items():
        stored = (w * n + 7) // 8
        body = np.stack([raw[starts[k] + _HEAD.size:starts[k] + _HEAD.size + stored] for k in blocks])
        values = _get_bits(body, w, n)
        for row, k in enumerate(blocks):
            low, _, outliers, _ = heads[k]
            if outliers:
                place = starts[k] + _HEAD.size + stored
                at = np.frombuffer(data, "<u2", outliers, place)
                values[row, at] |= np.frombuffer(data, "<u4", outliers, place + 2 * outliers) << np.uint32(w)
            out[ends[k] - n:ends[k]] = values[row] + np.uint32(low)
    return out


class Writer:
    """Writes one file from a stream of documents, holding less than a block plus one batch."""

    def __init__(self, sink):
        self._sink, self._place, self._rest, self._ids = sink, 0, np.zeros(0, np.uint32), 0
        self._starts: list[int] = []
        self._docs: list[tuple[int | None, int]] = []

    def add(self, docs: list, coded: list[bytes]) -> None:
        self._docs += [(d, len(c) // 4) for d, c in zip(docs, coded)]
        fresh = np.concatenate([self._rest, np.frombuffer(b"".join(coded), "<u4")])
        whole = len(fresh) // BLOCK * BLOCK
        self._put(fresh[:whole])
        self._rest = fresh[whole:]

    def _put(self, ids: np.ndarray) -> None:
        for first in range(0, len(ids), 256 * BLOCK):
            for block in pack_blocks(ids[first:first + 256 * BLOCK]):
                self._starts.append(self._place)
                self._sink.write(block)
                self._place += len(block)
        self._ids += len(ids)

    def close(self) -> tuple[int, int]:
        self._put(self._rest)
        index = np.array(self._starts, "<u8").tobytes()
        table = b"".join((np.array([d or 0 for d, _ in self._docs], "<i8").tobytes(), np.array([n for _, n in self._docs], "<u8").tobytes(),
                          np.array([d is None for d, _ in self._docs], "u1").tobytes()))
        self._sink.write(index)
        self._sink.write(table)
        self._sink.write(_FOOT.pack(self._ids, len(self._starts), len(self._docs), self._place, self._place + len(index), _MAGIC))
        return len(self._docs), self._ids


class Reader:
    """Reads one file: its documents, a run of ids, or all documents as a stream of batches."""

    def __init__(self, source):
        self._source = source
        source.seek(source.size() - _FOOT.size)
        self.ids, blocks, docs, index, table, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != _MAGIC:
            raise ValueError("this is not a token file")
        source.seek(index)
        self._starts = np.append(np.frombuffer(source.read(8 * blocks), "<u8").astype(np.int64), index)
        source.seek(table)
        stored, counts, empty = source.read(8 * docs), source.read(8 * docs), source.read(docs)
        self.keys = [None if e else int(d) for d, e in zip(np.frombuffer(stored, "<i8"), np.frombuffer(empty, "u1"))]
        self.counts = np.frombuffer(counts, "<u8").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the file, through the block index."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        self._source.seek(int(self._starts[a]))
        data = self._source.read(int(self._starts[b] - self._starts[a]))
        return unpack_blocks(data, self._starts[a:b] - self._starts[a])[first - a * BLOCK:last - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k] + self.counts[k]))

    def digests(self, run: int = 1 << 19):
        """(key, start in the file, count, crc32) of every document, reading about ``run`` ids at a time."""
        k = 0
        while k < len(self.keys):
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + run, "left")))
            base, end = int(self.starts[k]), int(self.starts[stop - 1] + self.counts[stop - 1])
            crcs = [0] * (stop - k)
            for first in range(base, end, run) if end > base else ():
                some = self.read(first, min(end, first + run)).astype("<u4")
                for d in range(k, stop):
                    a, b = max(first, int(self.starts[d])), min(first + len(some), int(self.starts[d] + self.counts[d]))
                    if a < b:
                        crcs[d - k] = zlib.crc32(some[a - first:b - first].tobytes(), crcs[d - k])
            yield from zip(self.keys[k:stop], self.starts[k:stop].tolist(), self.counts[k:stop].tolist(), crcs)
            k = stop


def _write(path: str, end_id: int, folder: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        address = f"{folder}/tokens-{number:06d}.pfor"
        encode, done = coder(path), [0, 0]

        def fill(sink):
            writer = Writer(sink)
            for batch in batches:
                for first, last in batches_of(batch.column(1)):
                    part = batch.slice(first, last - first)
                    texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
                    writer.add(part.column(0).to_pylist(), [c + end for c in encode(texts)])
            done[:] = writer.close()

        put_file(address, fill)
        yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int32()), "address": [address],
                                          "docs": pa.array([done[0]], pa.int64()), "ids": pa.array([done[1]], pa.int64())})
    return run


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 1, key: str = "doc_id",
                 text: str = "text", file_bytes: int = 32 << 20) -> DataFrame:
    """Write the ids of all documents in ascending key order; returns the list of files: file, address, docs, ids, base.

    The table is range-partitioned by key (null first) into files of about ``file_bytes`` of text, and by a hash of
    the text among rows with one key. A null text is empty: it has the end id alone. Repeated rows are all written; an
    empty table gives no file with documents. Other columns are ignored. ``base`` is the number of ids in all files before.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = narrow.withColumn("h", F.xxhash64("text")).repartitionByRange(int(files), "id", "h").sortWithinPartitions("id", "h").drop("h")
    listed = materialize(ordered.mapInArrow(_write(tokenizer or word_bpe_path(), end_id, folder), "file int, address string, docs long, ids long"))
    return exclusive_offsets(listed, [], "file", "ids", "base")


def _read(batches):
    for batch in batches:
        for address, base in zip(*[batch.column(c).to_pylist() for c in ("address", "base")]):
            with open_file(address) as source:
                keys, starts, counts, crcs = [list(column) for column in zip(*Reader(source).digests())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(counts, pa.int64()),
                                              pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the listed files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    spread = files.where("docs > 0").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", key)


def round_trip(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them."""
    return read_tokens(write_tokens(docs, **options), options.get("key", "doc_id"))
