"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has a capacity of tokens, of documents and of attention cost (the sum of squared lengths). Pieces come in
falling size; each goes to the open sequence that scores best among those with room in every dimension.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import batches_of
from placegrid.llm.tokens import coder, word_bpe_path
from placegrid.session import materialize

_PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, score: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, for lengths in falling order.

    ``residual`` takes the sequence whose scaled residual after placing has the smallest norm, ``dot`` the one whose
    scaled residual has the largest weighted dot product with the piece. Ties go to the earliest sequence.
    """
    limits = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    weights = np.array([1.0, 1 / 16, 1 / 16])
    room = np.empty((1024, 3))
    number = np.empty(1024, np.int64)
    opened = live = 0
    to, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    smallest = int(lengths.min()) if len(lengths) else 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, float(length) * float(length)])
        if (need > limits).any():
            raise ValueError("a piece is larger than a whole sequence may be")
        free = room[:live]
        fits = np.flatnonzero((free[:, 0] >= need[0]) & (free[:, 1] >= need[1]) & (free[:, 2] >= need[2]))
        if len(fits):
            scaled = free[fits] / limits
            if score == "dot":
                k = fits[np.argmax(scaled @ (weights * need / limits))]
            else:
                k = fits[np.argmin((((scaled - need / limits) ** 2) * weights).sum(axis=1))]
        else:
            if live == len(room):
                room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, np.empty_like(number)])
            k = live
            room[k], number[k] = limits, opened
            opened, live = opened + 1, live + 1
        to[i], at[i] = number[k], capacity - room[k, 0]
        room[k] -= need
        if room[k, 0] < smallest or room[k, 1] < 1:  # nothing fits any more; order of opening is kept
            room[k:live - 1], number[k:live - 1] = room[k + 1:live].copy(), number[k + 1:live].copy()
            live -= 1
    return to, at


def _piece_rows(path: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = coder(path)
        for batch in batches:
            for first, last in batches_of(batch.column(1)):
                part = batch.slice(first, last - first)
                ids, rows = part.column(0).to_pylist(), []
                for doc, coded in zip(ids, encode(pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist())):
                    coded += end
                    for k, byte in enumerate(range(0, len(coded), 4 * capacity)):
                        piece = coded[byte:byte + 4 * capacity]
                        rows.append((doc, k, byte // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def _pack(capacity: int, max_docs: int, max_cost: int, score: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "place"], ascending=[False, True], kind="stable")
        to, at = vector_best_fit(pdf["length"].to_numpy(), capacity, max_docs, max_cost, score)
        return pd.DataFrame({"place": pdf["place"], "length": pdf["length"], "sequence_id": pdf["deal"].to_numpy() * (1 << 32) + to, "offset": at})
    return run


def pack(docs: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_cost: int | None = None, end_id: int = 1,
         tokenizer: str | None = None, key: str = "doc_id", text: str = "text", deal_sequences: int = 2_000, deal_pieces: int = 100_000,
         score: str = "residual") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than ``capacity`` tokens are cut into full pieces and a rest. Pieces are dealt by a hash into
    groups of about ``deal_sequences`` full sequences and at most about ``deal_pieces`` pieces, and each group is packed by
    best fit. The sequences of a group that are not filled to half, few beside those that are, are taken apart, and
    their pieces of all groups are dealt and packed once more.
    Unset document and cost capacities are ``capacity`` documents and ``capacity`` squared, which tokens alone keep.
    A null text is empty and has one piece, the end id. Null keys and repeated rows are packed like others; an empty
    table gives no rows. Other columns are ignored. The key must be an integer.
    """
    limits = (capacity, max_docs or capacity, max_cost or capacity * capacity)
    pieces = materialize(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
                         .mapInArrow(_piece_rows(tokenizer or word_bpe_path(), end_id, capacity), _PIECES)
                         .withColumn("place", F.monotonically_increasing_id()))

    def placed(rows: DataFrame, first_deal: int) -> tuple[DataFrame, int]:
        many, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        deals = max(1, -(-total // (deal_sequences * capacity)), -(-many // deal_pieces))
        dealt = rows.select("place", "length", (F.pmod(F.xxhash64("place"), F.lit(deals)) + first_deal).alias("deal"))
        return materialize(dealt.groupBy("deal").applyInPandas(_pack(*limits, score), "place long, length long, sequence_id long, offset long")), deals

    first, deals = placed(pieces, 0)
    if deals > 1:
        half = first.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") * 2 <= capacity).select("sequence_id")
        again, _ = placed(materialize(first.join(half, "sequence_id", "left_semi").select("place", "length")), deals)
        first = first.join(half, "sequence_id", "left_anti").unionByName(again)
    return (pieces.join(first.select("place", "sequence_id", "offset"), "place")
            .select(F.col("id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
