"""Near-dedup by SimHash fingerprints, with BK-trees to find those within a few bits.

Fingerprints within three bits of each other agree in one of four 16-bit blocks, so a shard is all fingerprints with
one value in one block. Each shard is a BK-tree; a shard that is too large is split again by blocks of its other bits,
and one that stays too large becomes several trees, each met by the fingerprints of every other. Links inside a tree's
task are reduced to a spanning forest before they leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import batches_of
from placegrid.llm.components import roots
from placegrid.session import materialize

RADIUS = 3
#: Most fingerprints in one tree.
TREE = 1024


# --- fingerprints --------------------------------------------------------------------------------------------------

def fingerprint(text: bytes, size: int = 3, step: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42), each occurrence counted."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for first in range(0, total, step):
        some = words[first:first + step + size - 1]
        if len(words) < size:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*[some[k:] for k in range(size)]))
        hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            for first, last in batches_of(batch.column(0)):
                part = batch.slice(first, last - first)
                texts = pc.fill_null(part.column(0), "").cast(pa.binary()).to_pylist()
                found = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), *part.columns[1:]], names=["fp", *batch.schema.names[1:]])
    return run


# --- trees ---------------------------------------------------------------------------------------------------------

class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self._children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self._children.append({})
        node, new = 0, len(self.values) - 1
        while node != new:
            node = self._children[node].setdefault((self.values[node] ^ value).bit_count(), new)

    def within(self, value: int, radius: int):
        """Numbers of the nodes within ``radius``, following only edges that can lead to one."""
        open_nodes = [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            away = (self.values[node] ^ value).bit_count()
            if away <= radius:
                yield node
            for edge, child in self._children[node].items():
                if away - radius <= edge <= away + radius:
                    open_nodes.append(child)


def forest(indexed: list[int], asking: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join everything within ``radius``: among ``indexed``, or from ``asking`` to ``indexed``.

    Each value is linked to the smallest of its piece, so there are fewer links than values.
    """
    values = indexed + (asking or [])
    parent = list(range(len(values)))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    tree = BKTree()
    if asking is None:
        for k, value in enumerate(indexed):
            for other in tree.within(value, radius):
                parent[top(k)] = top(other)
            tree.add(value)
    else:
        for value in indexed:
            tree.add(value)
        for k, value in enumerate(asking, len(indexed)):
            for other in tree.within(value, radius):
                parent[top(k)] = top(other)
    least: dict[int, int] = {}
    for k, value in enumerate(values):
        least[top(k)] = min(value, least.get(top(k), value))
    return [(value, least[top(k)]) for k, value in enumerate(values) if value != least[top(k)]]


def _links(radius: int):
    """Streams groups (shard, a, b), which arrive together and in order; one group is held at a time."""
    full = (1 << 64) - 1

    def signed(pairs):
        return [(u - (1 << 64) * (u >> 63), v - (1 << 64) * (v >> 63)) for u, v in pairs]

    def solve(group, members):
        _, a, b = group
        own = sorted({fp & full for part, fp in members if part == a})
        return signed(forest(own, None if a == b else sorted({fp & full for part, fp in members if part == b}), radius))

    def run(batches):
        group, members = None, []
        for batch in batches:
            out = []
            for *key, part, fp in zip(*[batch.column(c).to_pylist() for c in ("shard", "a", "b", "part", "fp")]):
                if tuple(key) != group:
                    out += solve(group, members) if len(members) > 1 else []
                    group, members = tuple(key), []
                members.append((part, fp))
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})
        out = solve(group, members) if len(members) > 1 else []
        yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})
    return run


def _block(bits, start: int, width: int):
    return F.shiftrightunsigned(bits, start).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``radius`` (at most 3) of each other."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find distances up to 3")
    fp = F.col("fp")
    first = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _block(fp, 16 * j, 16).alias("value")) for j in range(4)])).alias("s"))
    first = first.select("fp", "s.j", (F.col("s.value") * 4 + F.col("s.j")).alias("shard"))
    sizes = first.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    first = first.join(sizes, "shard")
    plain = first.where(F.col("size") <= tree).select("shard", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("part"), "fp")

    # The 48 bits beside a full block differ in at most three places, so one of their four 12-bit blocks agrees as well.
    rest = F.when(F.col("j") == 0, F.shiftrightunsigned(fp, 16))
    for j in (1, 2, 3):
        rest = rest.when(F.col("j") == j, _block(fp, 0, 16 * j).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, 16 * j), 16), 16 * j)))
    second = first.where(F.col("size") > tree).select("fp", "shard", rest.alias("rest"))
    second = second.select("fp", F.explode(F.array(*[((F.col("shard") * 4 + k) * 4096 + _block(F.col("rest"), 12 * k, 12) + (1 << 32)) for k in range(4)])).alias("shard"))
    parts = second.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(tree)).cast("int").alias("parts"), F.count(F.lit(1)).alias("size")).where("size > 1")
    second = second.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    second = second.select("shard", "fp", "part", met)
    second = second.select("shard", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp")

    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = plain.unionByName(second).repartition(n, "shard", "a", "b").sortWithinPartitions("shard", "a", "b")
    return dealt.select("shard", "a", "b", "part", "fp").mapInArrow(_links(radius), "u long, v long").distinct()


# --- the operator --------------------------------------------------------------------------------------------------

def components_of(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and root for every distinct fingerprint; the root is some fingerprint of the component."""
    prints = materialize(marked.select("fp").distinct())
    found = roots(links(prints, radius))
    return prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, radius: int = RADIUS, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (the smallest key reachable by links).

    A null text counts as empty; texts without words have fingerprint zero and are linked like others. A null key is
    never a component_id unless all keys of the component are null. Repeated rows give a row each; an empty table
    gives no rows. Other columns are ignored. The key must be an integer.
    """
    marked = materialize(docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("id")).mapInArrow(_fingerprints(size), "fp long, id long"))
    pieces = materialize(components_of(marked, radius))
    least = marked.groupBy("fp").agg(F.min("id").alias("id")).join(pieces, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    named = pieces.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of every component (a null key last, then the first read), with all columns."""
    columns = docs.columns
    wide = docs.select(F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    schema = "fp long, " + ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(columns))
    marked = materialize(wide.mapInArrow(_fingerprints(size), schema).withColumn("place", F.monotonically_increasing_id()))
    own = F.col(f"c{columns.index(key)}")
    order = F.struct(own.isNull().alias("missing"), own.alias("id"), F.col("place").alias("place"))
    first = marked.groupBy("fp").agg(F.min(order).alias("best"))
    kept = first.join(components_of(marked, radius), "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.place").alias("place"))
    return marked.join(kept, "place", "left_semi").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
