"""The piece coder against the tokenizers library on texts that mix cases, marks, accents and special tokens."""

import random
import tracemalloc

import numpy as np

from placegrid.llm import tokens

PARTS = list("aAbHhİIiΣσßǅé̸̱कक़'’.,!<>|=$#%_-^`~123٣Ⅷ½ \t\n\x0b 　") + [
    "'s", "'S", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext|>", "<|startoftext", "Hello,", "WORLD!!", "x'.", "a<|endoftext|>b", "😀", "\x00", "\x1c", "\x85"]


def test_ids_equal_those_of_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3000)  # starts anew several times
    path = tokens.word_bpe_path()
    coder, library, draw = tokens.PieceCoder(path), tokens._tokenizer(path), random.Random(3)
    for _ in range(8):
        texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12))) for _ in range(1000)] + ["", "A" * 5000 + "."]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert coder([t.encode() for t in texts]) == want


def test_words_of_letters_are_encoded_many_at_a_time():
    coder = tokens.PieceCoder(tokens.word_bpe_path())
    plain, asked = tokens._tokenizer(tokens.word_bpe_path()), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    coder._tokenizer = Counting()
    letters = "abcdefghéüß"
    texts = [" ".join(a + b + c for b in letters for c in letters) for a in letters] + ["", " ", "ÉTÉ, été. Été!", "× a×b ÷ ª İ ẞ Été"]
    found = coder([t.encode() for t in texts])
    assert found == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words = set().union(*[t.split() for t in texts])
    assert len(asked) < len(words) / 16
    assert "ÉTÉ".encode() not in coder._known  # kept in lower case, without marks
    assert coder([b""]) == [b""]


def test_memory_does_not_follow_the_texts_given_at_once():
    """16 MB of known words take little more than their ids, which are 13 MB here."""
    coder, texts = tokens.PieceCoder(tokens.word_bpe_path()), [b"one more word here " * 10_000] * 84
    want = coder(texts[:1]) * len(texts)
    tracemalloc.start()
    try:
        found = coder(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == want
    assert peak < sum(map(len, found)) + (32 << 20)
