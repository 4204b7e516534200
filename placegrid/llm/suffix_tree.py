"""Language-model scores from a probabilistic suffix tree over words.

A state is a context of up to ``depth`` words. It is kept if coding what follows it with its own distribution, smoothed
by that of its suffix, gains more than ``threshold`` nats over the suffix alone. A word is scored in the longest kept
state that ends before it.

The corpus is cut into blocks of documents. Counts never meet in one place: each block asks, shard by shard, for the
sums over the corpus of the n-grams it holds, and every shard answers every block. Contexts are grown word by word, so
only n-grams after a context that is frequent enough are asked for. Blocks are files in the shared folder.

Words have 64-bit hashes until they are counted; those met twice are numbered then, and a pair of them is its two
numbers, which takes half the bytes of a hash.
"""

from __future__ import annotations

import io
import uuid
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import forget, id_remainder, mix, open_file, put_file, shared_folder, text_arrays, word_bounds, word_hashes
from placegrid.session import materialize

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 6 << 20
_END = np.uint64(0x5DEECE66D1234567)
_STEP = np.uint64(0xA0761D6478BD642F)
_ASK = "block string, shard int, keys binary, sums binary"


# --- arrays as bytes -----------------------------------------------------------------------------------------------

def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: they compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _small(data: bytes) -> bytes:
    """Compressed, with the size in front. What is shuffled is compressed without a code for single bytes otherwise."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _large(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _spread(values: np.ndarray, width: int) -> np.ndarray:
    """A bijection of ``width``-bit values that spreads them over the shards."""
    mask, half = np.uint64((1 << width) - 1), np.uint64(width // 2)
    for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        values = ((values ^ (values >> half)) * np.uint64(odd)) & mask
    return values


def _requests(block: str, keys: np.ndarray, sums: np.ndarray, bits: int, width: int = 64):
    """Rows for each shard of the sorted ``keys`` of ``width`` bits; ``sums`` are counts, or the rows that ``_gains_as_bytes`` takes."""
    cuts = np.searchsorted(keys >> np.uint64(width - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for shard in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[shard], cuts[shard + 1])
        told = _counts_as_bytes(sums[own]) if sums.ndim == 1 else _gains_as_bytes(sums[:, own])
        yield block, int(shard), _small(_planes(np.diff(keys[own], prepend=np.uint64(0)))), _small(told)


def _asked_keys(asked: pd.DataFrame) -> list[np.ndarray]:
    return [np.cumsum(_from_planes(_large(k), "<u8"), dtype=np.uint64) for k in asked["keys"]]


def _counts_as_bytes(values: np.ndarray) -> bytes:
    """Whole numbers in as few planes as the largest needs, with the number of planes in front."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _counts_from_bytes(data: bytes, many: int = -1, start: int = 0) -> np.ndarray:
    """``many`` whole numbers from ``start`` on, or all that follow."""
    width = data[start]
    planes = np.frombuffer(data, np.uint8, many * width if many >= 0 else -1, start + 1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _gains_as_bytes(rows: np.ndarray) -> bytes:
    """Gain, seen, types and count of contexts: a bit map of those that have any, and the four of these alone."""
    told = rows[2] > 0
    return np.packbits(told).tobytes() + _planes(rows[0, told]) + b"".join(_counts_as_bytes(row) for row in rows[1:, told])


def _gains_from_bytes(data: bytes, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of ``n`` contexts have any, and the four rows of these."""
    told, place = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8), count=n).astype(bool), (n + 7) // 8
    many = int(told.sum())
    rows = [_from_planes(data[place:place + 8 * many], "<f8")]
    place += 8 * many
    for _ in range(3):
        rows.append(_counts_from_bytes(data, many, place))
        place += 1 + many * data[place]
    return told, rows


def _answer(least: int, number: bool = False):
    """Adds up counts of one shard: every block gets those of its keys that are ``least`` or more, and which of these it
    is the first to hold. A bit map tells which keys they are; the others count as zero from then on.

    With ``number`` the keys met twice are numbered in the shard, and a block gets the numbers of its own instead."""
    def run(asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("block")
        keys = _asked_keys(asked)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([_counts_from_bytes(_large(s)) for s in asked["sums"]]), minlength=len(distinct)).astype(np.int64)
        own = np.zeros(len(place), np.uint8)
        own[first] = 1
        told, numbers = total[place], np.cumsum(total >= 2) - 1
        rows = []
        for b, s, i, j in zip(asked["block"], asked["shard"], cuts, cuts[1:]):
            kept = told[i:j] >= least
            more = _counts_as_bytes(np.diff(numbers[place[i:j][told[i:j] >= 2]], prepend=0)) if number else np.packbits(own[i:j]).tobytes()
            rows.append((b, s, _small(_counts_as_bytes(told[i:j][kept])), _small(np.packbits(kept).tobytes() + more), j - i))
        out = pd.DataFrame(rows, columns=["block", "shard", "sums", "own", "n"])
        out["types"], out["tokens"], out["numbers"] = 0, 0.0, 0
        out.loc[0, "types"], out.loc[0, "tokens"], out.loc[0, "numbers"] = int((total > 0).sum()), float(total.sum()), int((total >= 2).sum())
        return out
    return run


def _answer_kept(discount: float, threshold: float):
    """Adds up what the blocks tell of the contexts of one shard and decides which are kept: every block that asks gets
    a bit map of these, and what was seen after them and of how many types."""
    def run(asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("block")
        keys = _asked_keys(asked)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        gain, seen, types, whole = np.zeros((4, len(distinct)))
        for sums, i, j in zip(asked["sums"], cuts, cuts[1:]):
            told, rows = _gains_from_bytes(_large(sums), j - i)
            at = place[i:j][told]  # once each, as the keys of a block are distinct
            gain[at] += rows[0]
            seen[at] += rows[1]
            types[at] += rows[2]
            whole[at] = rows[3]
        mass, whole = seen - discount * types, np.maximum(whole, 1)
        kept = (mass > 0) & (gain + (whole - seen) * np.log(np.maximum(1 - mass / whole, 1e-12)) > threshold)
        out = []
        for b, s, i, j in zip(asked["block"], asked["shard"], cuts, cuts[1:]):
            own = place[i:j]
            some = own[kept[own]]
            out.append((b, s, _small(_counts_as_bytes(seen[some]) + _counts_as_bytes(types[some])), _small(np.packbits(kept[own]).tobytes()), j - i, 0, 0.0, 0))
        return pd.DataFrame(out, columns=["block", "shard", "sums", "own", "n", "types", "tokens", "numbers"])
    return run


def _exchange(asked: DataFrame, answer) -> DataFrame:
    return materialize(asked.groupBy("shard").applyInPandas(
        answer, "block string, shard int, sums binary, own binary, n long, types long, tokens double, numbers long"))


def _counted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts and first-holder marks in the order of the block's sorted keys."""
    pdf = pdf[pdf["shard"] >= 0].sort_values("shard")
    counts, marks = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for sums, bits, n in zip(map(_large, pdf["sums"]), map(_large, pdf["own"]), pdf["n"]):
        half = (n + 7) // 8
        kept = np.unpackbits(np.frombuffer(bits, np.uint8, half), count=n).astype(bool)
        own = np.zeros(n, np.int64)
        own[kept] = _counts_from_bytes(sums)
        counts.append(own)
        marks.append(np.unpackbits(np.frombuffer(bits, np.uint8, half, half), count=n).astype(bool))
    return np.concatenate(counts), np.concatenate(marks)


def _numbered(pdf: pd.DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's words in the order of their hashes, and the numbers of those met twice."""
    pdf = pdf[pdf["shard"] >= 0].sort_values("shard")
    counts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shard, sums, told, n in zip(pdf["shard"], map(_large, pdf["sums"]), map(_large, pdf["own"]), pdf["n"]):
        half = (n + 7) // 8
        own = np.zeros(n, np.int64)
        own[np.unpackbits(np.frombuffer(told, np.uint8, half), count=n).astype(bool)] = _counts_from_bytes(sums)
        counts.append(own)
        numbers.append(np.cumsum(_counts_from_bytes(told, int((own >= 2).sum()), half).astype(np.int64)) << bits | shard)
    return np.concatenate(counts), np.concatenate(numbers)


def _decided(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts are kept, in the order of the block's sorted keys; what was seen after these and of how many types."""
    pdf = pdf[pdf["shard"] >= 0].sort_values("shard")
    kept, seen, types = [np.zeros(0, bool)], [np.zeros(0)], [np.zeros(0)]
    for sums, bits, n in zip(map(_large, pdf["sums"]), map(_large, pdf["own"]), pdf["n"]):
        own = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        many = int(own.sum())
        for rows, start in ((seen, 0), (types, 1 + many * sums[0])):
            row = np.zeros(n)
            row[own] = _counts_from_bytes(sums, many, start)
            rows.append(row)
        kept.append(own)
    return np.concatenate(kept), np.concatenate(seen), np.concatenate(types)


# --- blocks --------------------------------------------------------------------------------------------------------

def _save(address: str, **columns: np.ndarray) -> None:
    """Numbers by bytes of equal weight, which compress well."""
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    split = {k: "BYTE_STREAM_SPLIT" for k, v in columns.items() if v.dtype != bool}
    put_file(address, lambda sink: pq.write_table(table, sink, compression="zstd", use_dictionary=False, column_encoding=split))


def _by_use(uses: np.ndarray) -> np.ndarray:
    """Words of a block in falling order of their uses there: numbers in this order compress better."""
    return np.argsort(-uses.astype(np.int64), kind="stable")


def _load(address: str) -> dict[str, np.ndarray]:
    with open_file(address) as source:
        table = pq.read_table(io.BytesIO(source.read()))
    return {c: table[c].to_numpy() for c in table.column_names}


class Block:
    """Word numbers (in the order of the words' hashes) and document bounds of one block."""

    def __init__(self, folder: str, name: str, frequent: int, width: int):
        self.name, self._at, self._frequent, self._width, self._found = name, f"{folder}/{name}", frequent, width, {}
        self.tokens = _by_use(self.get("uses")["uses"])[self.get("tokens")["token"]]
        with open_file(f"{self._at}.docs") as source:
            docs = pq.read_table(io.BytesIO(source.read()))
        self.keys, self.held, self.lengths = docs["id"].to_pylist(), docs["held"].to_numpy(), docs["length"].to_numpy()
        self.inside = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.trained = np.repeat(~self.held, self.lengths)

    @cached_property
    def numbers(self) -> np.ndarray:
        """The corpus's number of the word at each place; 0 for words that are not met twice, which no n-gram asked for holds."""
        many = self.get("count1")["count"] >= 2
        out = np.zeros(len(many), np.uint64)
        out[many] = self.get("numbers")["number"].view(np.uint64)
        return out[self.tokens]

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words that end at each place; without meaning in the first n - 1 places of a document."""
        words = out = mix(self.numbers + np.uint64(1))
        for _ in range(n - 1):
            out = np.concatenate([out[:1], mix(out[:-1] * _STEP + words[1:])])
        return out

    def keys_of(self, n: int, places: np.ndarray, width: int) -> tuple[np.ndarray, int]:
        """Keys of the n-grams that end at these places, and their bits: two numbers of ``width`` bits for a pair or a
        word (then the first is one that no word has), or a hash."""
        if n <= 2 and width <= 32:
            first = self.numbers[places - 1] if n == 2 else np.uint64((1 << width) - 1)
            return _spread((first << np.uint64(width)) | self.numbers[places], 2 * width), 2 * width
        return self.grams(n)[places], 64

    def put(self, name: str, **columns: np.ndarray) -> None:
        _save(f"{self._at}.{name}", **columns)

    def get(self, name: str) -> dict[str, np.ndarray]:
        return _load(f"{self._at}.{name}")

    def counts(self, n: int) -> np.ndarray:
        """Corpus count of the n words that end at each place; 0 where they were not asked for."""
        if n == 1:
            return self.get("count1")["count"][self.tokens]
        if n not in self._found:
            places, _, _, _, place = self.asked(n)
            self._found[n] = np.zeros(len(self.tokens), np.int64)
            self._found[n][places] = self.get(f"count{n}")["count"][place]
        return self._found[n]

    def owned(self, n: int) -> np.ndarray:
        """Whether a gram stands at a place that this block is the first to hold; one place of each."""
        places, _, _, first, _ = self.asked(n)
        out = np.zeros(len(self.tokens), bool)
        out[places[first[self.get(f"count{n}")["own"]]]] = True
        return out

    def after(self, n: int) -> np.ndarray:
        """Places that follow a context of n - 1 words that is frequent enough."""
        before = np.concatenate([[0], self.counts(n - 1)[:-1]])
        return np.flatnonzero((self.inside >= n - 1) & (before >= self._frequent))

    def asked(self, n: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
        """Those of them whose n-gram may occur again, as its last n - 1 words do; the bits of its key, the sorted keys,
        where each is first and which of them stands at each place."""
        if ("asked", n) not in self._found:
            places = self.after(n)
            places = places[self.counts(n - 1)[places] >= 2]
            keys, of = self.keys_of(n, places, self._width)
            self._found["asked", n] = places, of, *np.unique(keys, return_index=True, return_inverse=True)
        return self._found["asked", n]


def _cut(folder: str, bits: int):
    def write(held, ids, buffers):
        data, offsets = text_arrays(pa.concat_arrays(buffers))
        starts, ends, text = word_bounds(data, offsets)
        words = np.bincount(text, minlength=len(offsets) - 1)
        lengths = words + 1
        hashes = np.full(int(lengths.sum()), _END, np.uint64)
        hashes[np.arange(len(starts)) + text] = word_hashes(data, starts, ends)
        vocabulary, tokens = np.unique(hashes, return_inverse=True)
        name = uuid.uuid4().hex
        keys, held = pa.concat_arrays(ids), pa.concat_arrays(held).to_numpy(zero_copy_only=False)
        docs = pa.table({"id": keys, "held": held, "length": lengths})
        put_file(f"{folder}/{name}.docs", lambda sink: pq.write_table(docs, sink))
        uses = np.bincount(tokens, minlength=len(vocabulary))
        rank = np.empty(len(uses), np.int32)
        rank[_by_use(uses)] = np.arange(len(uses), dtype=np.int32)
        _save(f"{folder}/{name}.uses", uses=uses)
        _save(f"{folder}/{name}.tokens", token=rank[tokens])
        trained = np.bincount(tokens, weights=np.repeat(~held, lengths), minlength=len(vocabulary))
        rows = list(_requests(name, vocabulary, trained, bits))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                                          names=["block", "shard", "keys", "sums"])

    def run(batches):
        held, ids, texts, size = [], [], [], 0
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                data, _ = text_arrays(part.column(2))
                if texts and size + len(data) > BLOCK_BYTES:
                    yield write(held, ids, texts)
                    held, ids, texts, size = [], [], [], 0
                held, ids, texts, size = held + [part.column(1)], ids + [part.column(0)], texts + [part.column(2)], size + len(data)
        if texts:
            yield write(held, ids, texts)
    return run


def _grow(folder: str, n: int, frequent: int, bits: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Takes in the answers on n-1 words and asks for those on n."""
        block = Block(folder, pdf["block"].iloc[0], frequent, width)
        _take(block, pdf, n - 1, bits)
        places, of, keys, _, place = block.asked(n)
        seen = np.bincount(place, weights=block.trained[places], minlength=len(keys))
        return pd.DataFrame(list(_requests(block.name, keys, seen, bits, of)), columns=["block", "shard", "keys", "sums"])
    return run


def _take(block: Block, pdf: pd.DataFrame, n: int, bits: int) -> None:
    """Stores the counts of the n-grams that the block asked for, and which of these it is the first to hold."""
    if n == 1:
        found, numbers = _numbered(pdf, bits)
        block.put("count1", count=found)
        block.put("numbers", number=numbers)
        return
    found, own = _counted(pdf)
    block.put(f"count{n}", count=found, own=own)


def _contexts(block: Block, depth: int, width: int) -> tuple[np.ndarray, int, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted keys of the block's contexts, their bits, and for each order the places that follow one and which it is."""
    if depth > 2:
        width = 64  # longer contexts have hashes alone, and so have all that stand beside them
    places = [block.after(n) for n in range(2, depth + 2)]
    found = [block.keys_of(n, p - 1, width) for n, p in enumerate(places, 1)]
    keys, of = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, found[0][1], list(zip(places, np.split(of, np.cumsum([len(p) for p in places])[:-1])))


def _gains(folder: str, depth: int, frequent: int, discount: float, bits: int, width: int, tokens: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Takes in the last counts and asks which contexts are kept; tells of them gain, seen, types and count.

        Each repeated n-gram is put in by the block that is first to hold it, so it counts once.
        """
        block = Block(folder, pdf["block"].iloc[0], frequent, width)
        _take(block, pdf, depth + 1, bits)
        keys, of, after = _contexts(block, depth, width)
        sums = np.zeros((4, len(keys)))
        counts = {n: block.counts(n) for n in range(1, depth + 2)}
        for n in range(2, depth + 2):
            at, k = after[n - 2]
            told = (block.owned(n) & (counts[n] >= 2))[at]
            at, k = at[told], k[told]
            c, whole = counts[n][at], counts[n - 1][at - 1]
            parent = counts[n - 1][at] / (tokens if n == 2 else counts[n - 2][at - 1])
            for row, value in enumerate((c * np.log((c - discount) / whole / parent), c, np.ones(len(at)))):
                sums[row] += np.bincount(k, weights=value, minlength=len(keys))
            sums[3, k] = whole
        return pd.DataFrame(list(_requests(block.name, keys, sums, bits, of)), columns=["block", "shard", "keys", "sums"])
    return run


def _scores(folder: str, depth: int, frequent: int, discount: float, width: int, tokens: float, types: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(folder, pdf["block"].iloc[0], frequent, width)
        counts = block.counts(1)
        chance = (counts + 0.1) / (tokens + 0.1 * (types + 1))
        cuts = np.cumsum(block.lengths) - block.lengths
        base = np.add.reduceat(np.log10(chance), cuts)
        known = np.add.reduceat((counts > 0).astype(np.int64), cuts)
        chosen, seen, kinds = _decided(pdf)
        _, _, after = _contexts(block, depth, width)
        before = counts
        for n, (at, k) in enumerate(after, 2):
            now = block.counts(n)
            kept = chosen[k]
            at, k = at[kept], k[kept]
            whole = before[at - 1]
            rest = 1 - (seen[k] - discount * kinds[k]) / whole
            chance[at] = np.where(now[at] >= 2, now[at] - discount, 0) / whole + rest * chance[at]
            before = now
        return pd.DataFrame({"id": pd.array(block.keys, dtype="Int64"), "held_out": block.held, "n_tokens": block.lengths, "n_known": known,
                            "train_tokens": int(tokens), "base_score": base, "score": np.add.reduceat(np.log10(chance), cuts)})
    return run


def score(docs: DataFrame, depth: int = 2, frequent: int = 16, threshold: float = 6.0, discount: float = 0.75, key: str = "doc_id",
          text: str = "text", modulus: int = 10, held: int = 0) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Counts are over all documents that are not held out. A context must be met ``frequent`` times to be tried, the same at
    every size of the corpus; beyond that only the gain decides.
    P(w | state) = max(c - discount, 0) / n for n-grams met at least twice, plus the mass left times P(w | suffix); the
    root is the smoothed unigram distribution of the base score, so every state sums to one. Words are told apart by
    64-bit hashes. A null text counts as empty: it has the end token alone. A null key counts as empty text, whose
    remainder is 0. Repeated rows are scored like others; an empty table gives no rows. Other columns are ignored. The key must be an integer.
    """
    spark = docs.sparkSession
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    folder = shared_folder(spark, "blocks")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / BLOCK_BYTES)))))
    narrow = docs.select(F.col(key).cast("long").alias("id"), (id_remainder(key, modulus) == held).alias("held"), F.col(text).alias("text"))
    asked = materialize(narrow.mapInArrow(_cut(folder, bits), _ASK))
    waiting = materialize(asked.select("block").distinct()).select(
        "block", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("sums"), F.lit(None).cast("binary").alias("own"), F.lit(0).cast("long").alias("n"))

    def by_block(answers):  # a block that had nothing to ask takes part all the same
        return answers.select("block", "shard", "sums", "own", "n").unionByName(waiting).groupBy("block")

    answers = _exchange(asked, _answer(1, number=True))
    forget(asked)
    types, tokens, numbers = answers.agg(F.sum("types"), F.sum("tokens"), F.max("numbers")).first()
    if types is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    width = bits + int(numbers).bit_length()  # a word's number: its number in the shard and the shard
    for n in range(2, depth + 2):
        taken, answers = answers, _exchange(by_block(answers).applyInPandas(_grow(folder, n, frequent, bits, width), _ASK), _answer(2))
        forget(taken)
    taken, answers = answers, _exchange(by_block(answers).applyInPandas(_gains(folder, depth, frequent, discount, bits, width, tokens), _ASK), _answer_kept(discount, threshold))
    forget(taken)
    return by_block(answers).applyInPandas(_scores(folder, depth, frequent, discount, width, tokens, types), schema).withColumnRenamed("id", key)
