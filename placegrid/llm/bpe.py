"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf holds the rank of the pair that begins there; a node holds the smallest of its two. So the root names the
leftmost pair of lowest rank. A merge changes three leaves, and each change climbs to the root. Short words are
encoded many at a time, one tree per row of an array; a very long word has a tree of its own.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import batches_of, held
from placegrid.llm.tokens import KEPT, splits_at_gaps, word_bpe_path

_NONE = np.int64(1) << np.int64(62)
_LONG = 256
_PLAIN = re.compile(rb"[!-~]+")
#: The splitting pattern of the tokenizer file, for lower-cased printable ASCII.
_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class SegmentTreeBpe:
    """Encodes like the tokenizer file says; normalising and splitting of other than ASCII is left to its library."""

    def __init__(self, path: str):
        from placegrid.llm.tokens import _tokenizer

        if not splits_at_gaps(path):
            raise ValueError("the tokenizer file keeps white space; only files that drop it are supported")
        with open(path, encoding="utf-8") as source:
            parts = json.load(source)
        model, self._library = parts["model"], _tokenizer(path)
        if model["type"] != "BPE" or model.get("dropout") or parts.get("decoder"):
            raise ValueError("only BPE without dropout and without a decoder of its own is supported")
        vocab, tail = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self._inside = np.array([vocab[c] for c in letters], np.int64)
        self._last = np.array([vocab[c + tail] for c in letters], np.int64)
        self._raw = {ord(c): b for b, c in enumerate(letters)}
        self._special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self._special_at = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) or r"(?!)")
        self._names = {i: t for t, i in [*vocab.items(), *self._special.items()]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ends = [(vocab[a], vocab[b]) for a, b in pairs]
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([(a << 32) | b for a, b in ends], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._rank_of = dict(zip(ends, range(len(ends))))

    # -- one word ---------------------------------------------------------------------------------------------------

    def _long_word(self, symbols: list[int]) -> list[int]:
        count, size = len(symbols), 1
        while size < count:
            size *= 2
        made, ranks, top = self._made, self._rank_of, len(self._made)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        tree = [(top, 0)] * (2 * size)
        for i in range(count - 1):
            tree[size + i] = (ranks.get((symbols[i], symbols[i + 1]), top), i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        alive = [True] * count

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = (rank, i)
            while k > 1:
                k //= 2
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1][0] < top:
            rank, i = tree[1]
            gone = after[i]
            symbols[i], alive[gone], after[i] = int(made[rank]), False, after[gone]
            put(gone, top)
            if after[i] < count:
                before[after[i]] = i
                put(i, ranks.get((symbols[i], symbols[after[i]]), top))
            else:
                put(i, top)
            if before[i] >= 0:
                put(before[i], ranks.get((symbols[before[i]], symbols[i]), top))
        return [s for s, live in zip(symbols, alive) if live]

    # -- many words -------------------------------------------------------------------------------------------------

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE)

    def _many_words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``symbols`` has a word in each row, of ``lengths``; returns it after all merges, and which places live."""
        words, size = symbols.shape
        place = np.arange(size)
        alive = place < lengths[:, None]
        after = np.tile(place + 1, (words, 1))
        before = np.tile(place - 1, (words, 1))
        tree = np.full((words, 2 * size), _NONE, np.int64)
        if size > 1:
            ranks = self._pair_ranks(symbols[:, :-1], symbols[:, 1:])
            whole = (place[:-1] + 1) < lengths[:, None]
            tree[:, size:-1] = np.where(whole & (ranks < _NONE), ranks * size + place[:-1], _NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        levels = size.bit_length() - 1
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            root = tree[row, 1]
            i, rank = root % size, root // size
            gone = after[row, i]
            follow = after[row, gone]
            symbols[row, i], after[row, i], alive[row, gone] = self._made[rank], follow, False
            has_next = follow < lengths[row]
            before[row[has_next], follow[has_next]] = i[has_next]
            lead = before[row, i]
            has_lead = lead >= 0
            ahead = np.where(has_next, follow, i)
            behind = np.where(has_lead, lead, i)
            new = self._pair_ranks(symbols[row, i], symbols[row, ahead])
            old = self._pair_ranks(symbols[row, behind], symbols[row, i])
            tree[row, size + gone] = _NONE
            tree[row, size + i] = np.where(has_next & (new < _NONE), new * size + i, _NONE)
            tree[row[has_lead], size + lead[has_lead]] = np.where(old < _NONE, old * size + lead, _NONE)[has_lead]
            nodes = [size + gone, size + i, size + behind]
            for _ in range(levels):
                nodes = [n >> 1 for n in nodes]
                for n in nodes:
                    tree[row, n] = np.minimum(tree[row, 2 * n], tree[row, 2 * n + 1])
            row = row[tree[row, 1] < _NONE]
        return symbols, alive

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each split-off word, given as its raw bytes."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > _LONG:
                first = self._inside[np.frombuffer(word, np.uint8)]
                first[-1] = self._last[word[-1]]
                out[k] = self._long_word(first.tolist())
            elif word:
                classes.setdefault(1 << (len(word) - 1).bit_length(), []).append(k)
        for size, members in classes.items():
            for start in range(0, len(members), 1 << 15):
                some = members[start:start + (1 << 15)]
                lengths = np.array([len(words[k]) for k in some], np.int64)
                raw = np.zeros((len(some), size), np.uint8)
                raw[np.arange(size) < lengths[:, None]] = np.frombuffer(b"".join([words[k] for k in some]), np.uint8)
                symbols, ends = self._inside[raw], (np.arange(len(some)), lengths - 1)
                symbols[ends] = self._last[raw[ends]]
                symbols, alive = self._many_words(symbols, lengths)
                flat, stops = symbols[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
                begin = 0
                for k, stop in zip(some, stops):
                    out[k] = flat[begin:stop]
                    begin = stop
        return out

    # -- texts ------------------------------------------------------------------------------------------------------

    def _words(self, piece: bytes) -> list[bytes]:
        """Split-off words of a run without separators, normalised, as raw bytes."""
        if _PLAIN.fullmatch(piece):
            return _SPLIT.findall(piece.lower())
        text = self._library.normalizer.normalize_str(piece.decode("utf-8"))
        return [bytes(map(self._raw.__getitem__, map(ord, part))) for part, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _parts(self, piece: bytes) -> list:
        """Words, and ids of the special tokens that stand in the run."""
        if b"<" not in piece:
            return self._words(piece)
        text, out, begin = piece.decode("utf-8"), [], 0
        for found in self._special_at.finditer(text):
            out += self._words(text[begin:found.start()].encode()) if found.start() > begin else []
            out.append(self._special[found[0]])
            begin = found.end()
        return out + (self._words(text[begin:].encode()) if begin < len(text) else [])

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of runs without separators. Each distinct word of the call is merged once."""
        parts = [self._parts(p) for p in pieces]
        words = list({w for ps in parts for w in ps if isinstance(w, bytes)})
        ids = dict(zip(words, self.encode_words(words)))
        return [[i for w in ps for i in (ids[w] if isinstance(w, bytes) else (w,))] for ps in parts]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(text.encode().split()) for i in ids]

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        """Token strings joined by a space, as the library does for a file without a decoder; unknown ids are left out."""
        skipped = set(self._special.values()) if skip_special_tokens else set()
        return " ".join(self._names[i] for i in ids if i in self._names and i not in skipped)


def _digests(path: str):
    def run(batches):
        coder, ids, tokens = held(("bpe", path), lambda: (SegmentTreeBpe(path), {}, {}))
        for batch in batches:
            for first, last in batches_of(batch.column(1)):
                part = batch.slice(first, last - first)
                cut = [t.split() for t in pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()]
                new = list(set().union(*cut).difference(ids))
                if len(ids) + len(new) > KEPT // 2:  # two entries for each piece
                    ids.clear(), tokens.clear()
                    new = list(set().union(*cut))
                for piece, found in zip(new, coder.encode_pieces(new)):
                    ids[piece] = " ".join(map(str, found)).encode()
                    tokens[piece] = coder.decode(found).encode()
                counts, id_sums, text_sums = [], [], []
                for pieces in cut:
                    listed = b" ".join(filter(None, map(ids.__getitem__, pieces)))
                    counts.append(listed.count(b" ") + 1 if listed else 0)
                    id_sums.append(hashlib.sha256(listed).hexdigest())
                    text_sums.append(hashlib.sha256(b" ".join(filter(None, map(tokens.__getitem__, pieces)))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                                                 names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256 of the whole text encoded and decoded again.

    A null text counts as empty and has no ids. Null keys and repeated rows give a row each; an empty table gives no
    rows. Other columns are ignored. The key must be an integer.
    """
    return (docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
            .mapInArrow(_digests(tokenizer or word_bpe_path()), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", key))


def _encode_rows(path: str):
    def run(batches):
        coder = SegmentTreeBpe(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(t) for t in texts], pa.list_(pa.int32()))], names=["id", "ids"])
    return run


def encode(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of each whole text as an array; nulls and other cases as in ``encode_and_decode``."""
    return (docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
            .mapInArrow(_encode_rows(tokenizer or word_bpe_path()), "id long, ids array<int>").withColumnRenamed("id", key))
