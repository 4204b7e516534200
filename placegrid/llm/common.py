"""Helpers shared by the operators: text columns as arrays, word hashes, exact offsets, files in the shared folder."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placegrid.session import scratch_path

#: The six characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
GAPS = " \t\n\x0b\x0c\r"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[ord(c) for c in GAPS]] = True

_WINDOW = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


# --- workers -------------------------------------------------------------------------------------------------------

_held: dict[tuple, object] = {}


def held(name: tuple, make):
    """What ``make`` gives, kept by this worker process until another operator keeps something: one at a time.

    What earlier operators left free in this process goes back to the system first.
    """
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Nothing of earlier operators is kept by this process any more, and its memory goes back to the system."""
    _held.clear()
    _powers.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Memory that this process has free goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --- columns -------------------------------------------------------------------------------------------------------

def id_remainder(key: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def exclusive_offsets(counts: DataFrame, by: list[str], order: str, amount: str, name: str, width: int = 4096) -> DataFrame:
    """``counts`` with the sum of ``amount`` over the earlier rows of its group, for integer ``order`` from 0.

    In two levels, so that no window holds more than ``width`` rows or one row per ``width`` of them.
    """
    block = F.floor(F.col(order) / F.lit(width))
    split = counts.withColumn("__block", block)
    within = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = split.groupBy(*by, "__block").agg(F.sum(amount).alias("__sum"))
    above = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.withColumn("__base", F.coalesce(F.sum("__sum").over(above), F.lit(0))).drop("__sum")
    return (split.withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0)))
            .join(bases, [*by, "__block"]).withColumn(name, F.col(name) + F.col("__base")).drop("__base", "__block"))


def chosen_rows(labelled: DataFrame, label: str, rows: int, key: str) -> DataFrame:
    """At most ``rows`` keys with their label, taken evenly from all labels, by a hash of the key.

    ``labelled`` is narrow (key and label); a key that occurs again counts once. The result is bounded by ``rows``.
    The sizes of the most frequent labels, a bounded table, are broadcast, so that rows far from being chosen are
    left out before a label's rows meet; rarer labels go on whole.
    """
    once = labelled.groupBy(key).agg(F.max(label).alias(label)).where(F.col(label).isNotNull())
    sizes = F.broadcast(once.groupBy(label).agg(F.count(F.lit(1)).alias("__size")).orderBy(F.desc("__size"), label).limit(10_000))
    share = F.pmod(F.xxhash64(key), F.lit(1 << 20)) * F.col("__size")  # a label's turns are taken among few more than needed
    turn = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    near = F.coalesce(share < F.lit((rows + 100) * (1 << 20) * 5 // 4), F.lit(True))
    return (once.join(sizes, label, "left").where(near).withColumn("__turn", turn)
            .where(F.col("__turn") <= rows).orderBy("__turn", F.xxhash64(key)).limit(rows).drop("__turn", "__size"))


# --- texts as arrays -----------------------------------------------------------------------------------------------

def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of each; a null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


#: Every ASCII character but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word (a run without the separators), in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = separators[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins, closes = ~gap, ~gap
    begins[1:] &= gap[:-1] | first[1:-1]
    closes[:-1] &= gap[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power_table(name: str, base: int, length: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < length:
        table = np.full(max(length, _WINDOW + 1), base, dtype=np.uint64)
        table[0] = 1
        _powers[name] = table = np.multiply.accumulate(table)
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (Murmur's finaliser)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased, by polynomial prefix sums over windows of whole words."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW, "right")))
        piece = _LOWER[data[starts[i]:ends[j - 1]]].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _power_table("up", _BASE, len(piece))[:len(piece)], out=total[1:])
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        value = (total[b] - total[a]) * _power_table("down", inverse, len(piece))[a]
        out[i:j] = mix(value + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def batches_of(column: pa.Array, limit: int = 1 << 22):
    """(first, last) row ranges whose texts together hold about ``limit`` bytes; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        base = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + limit, "right")))
        yield first, last
        first = last


# --- files in the shared folder ------------------------------------------------------------------------------------

def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder as a full address, for files that tasks write by themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    return system.makeQualified(path).toString()


def forget(table: DataFrame) -> None:
    """Delete the files of a written table that no later step reads."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put_file(address: str, write) -> None:
    """Write a file under a name of this attempt, then rename it: a retried or doubled task leaves one whole file."""
    import uuid

    system, path = pafs.FileSystem.from_uri(address)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as sink:
        write(sink)
    system.move(draft, path)


def open_file(address: str):
    system, path = pafs.FileSystem.from_uri(address)
    return system.open_input_file(path)
