"""Encoding of whole texts with a public tokenizer file, one distinct piece between separators at a time."""

from __future__ import annotations

import json
import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from placegrid.llm.common import give_back, held

#: Distinct pieces a worker keeps; when more come, it starts anew. This bounds memory at about 250 MB, results do not depend on it.
KEPT = 1_200_000

_MARKS = string.punctuation.encode()
#: Words of ASCII and Latin-1 letters in UTF-8. They are composed already, so that lower case is all that a normaliser makes of them.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Words that are encoded as one text.
_TOGETHER = 32
#: Bytes of text that are looked up at a time: the arrays made for them take some twenty times as much. A longer text stands alone.
_AT_ONCE = 1 << 20


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splits_at_gaps(path: str) -> bool:
    """Whether texts may be cut at ASCII separators before encoding without any change of the ids.

    True for normalisers that work within a run of non-space characters and a splitter that drops white space.
    """
    with open(path, encoding="utf-8") as source:
        parts = json.load(source)
    normal, cut = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in steps)
    first = (cut.get("pretokenizers") or [cut])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
    glued = any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\x0b\x0c\r") for t in parts["added_tokens"])
    return plain and drops and not glued


def splits_at_marks(path: str) -> bool:
    """Whether a run of letters and digits and the ASCII punctuation after it are encoded apart, whatever the case.

    True for a splitter of letter runs, digits and other runs, after a lower-casing normaliser.
    """
    with open(path, encoding="utf-8") as source:
        parts = json.load(source)
    normal, cut = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    first = (cut.get("pretokenizers") or [cut])[0]
    runs = {r for r in first.get("pattern", {}).get("Regex", "").split("|") if not r.startswith("'")}
    plain = all(set("<>") <= set(t["content"]) for t in parts["added_tokens"])
    return plain and runs == {r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"} and any(s["type"] == "Lowercase" for s in normal.get("normalizers", [normal]))


def word_ends(path: str) -> np.ndarray | None:
    """For each id whether it ends a run that is encoded by itself; None for a model that does not mark these ends."""
    with open(path, encoding="utf-8") as source:
        model = json.load(source)["model"]
    suffix = model.get("end_of_word_suffix")
    if not suffix or model.get("unk_token") is not None:
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[k for token, k in model["vocab"].items() if token.endswith(suffix)]] = True
    return ends


class PieceCoder:
    """Ids of whole texts as little-endian 32-bit bytes. Pieces met before are looked up, new ones encoded in one call.

    Where the tokenizer allows it, what is kept are plain words in lower case and the punctuation after them, and many
    words of letters are encoded as one text, as the model marks where each ends.
    """

    def __init__(self, path: str):
        self._tokenizer = _tokenizer(path)
        self._whole = not splits_at_gaps(path)
        self._marks = not self._whole and splits_at_marks(path)
        self._ends = word_ends(path) if self._marks else None
        self._known: dict[bytes, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters alone."""
        found = self._tokenizer.encode_batch_fast([b" ".join(words[k:k + _TOGETHER]).decode("utf-8") for k in range(0, len(words), _TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        cuts = 4 * (np.flatnonzero(self._ends[ids]) + 1)
        if len(cuts) != len(words) or cuts[-1] != 4 * len(ids):  # a byte that the model does not know
            return self._encode(words)
        raw, cuts = ids.tobytes(), cuts.tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _parts(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each piece as a word and the marks after it; a piece of another form is all word."""
        out = []
        for piece in pieces:
            word = piece.rstrip(_MARKS)
            if word.isalnum():  # ASCII only
                out.append((word.lower(), piece[len(word):]))
            elif _LATIN.fullmatch(word):
                out.append((word.decode("utf-8").lower().encode("utf-8"), piece[len(word):]))
            elif word[-1:].isalnum() and b"<" not in piece:
                out.append((word, piece[len(word):]))
            else:
                out.append((piece, b""))
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self._whole:
            return self._encode(texts)
        out, first, size = [], 0, 0
        for k, text in enumerate(texts):
            if k > first and size + len(text) > _AT_ONCE:
                out += self._look_up(texts[first:k])
                first, size = k, 0
            size += len(text)
        out += self._look_up(texts[first:])
        give_back()
        return out

    def _look_up(self, texts: list[bytes]) -> list[bytes]:
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        pieces = cut.flatten().dictionary_encode()
        met, known = pieces.dictionary.cast(pa.large_binary()).to_pylist(), self._known
        for _ in range(2):
            found = list(map(known.get, met))
            absent = [k for k, ids in enumerate(found) if ids is None]
            fresh = [met[k] for k in absent]
            parts = self._parts(fresh) if self._marks else [(p, b"") for p in fresh]
            new = list(set().union(*parts).difference(known))
            if len(known) + len(new) <= KEPT:
                break
            known.clear()
        if self._ends is not None:
            words = list(filter(_LATIN.fullmatch, new))
            for first in range(0, len(words), 1 << 14):
                some = words[first:first + (1 << 14)]
                known.update(zip(some, self._encode_words(some)))
            new = [p for p in new if p not in known]
        for first in range(0, len(new), 4096):
            some = new[first:first + 4096]
            known.update(zip(some, self._encode(some)))
        for k, (word, marks) in zip(absent, parts):
            found[k] = known[word] + known[marks] if marks else known[word]
        return _joined(found, pieces.indices.to_numpy(), cut.offsets.to_numpy())


def _joined(found: list[bytes], turns: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The ids of every text, of whose pieces ``turns`` tells which of ``found`` they are; ``cuts`` bound its pieces."""
    flat = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts, sizes = (np.cumsum(sizes) - sizes)[turns], sizes[turns]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
    raw, ends = flat[place].tobytes(), (4 * ends[cuts]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def coder(path: str) -> PieceCoder:
    """The coder of this worker process for a tokenizer file."""
    return held(("tokens", path), lambda: PieceCoder(path))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
