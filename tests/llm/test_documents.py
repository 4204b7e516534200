"""Every document operator on edge cases against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from placegrid.llm import bpe, exact_dedup, language, packing, sharding, simhash, suffix_tree, token_file, toxicity
from placegrid.llm.tokens import word_bpe_path

SF = "/root/testdata/sf0.001"


def _texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe_path())


def test_exact_dedup(docs):
    rows = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    assert len(rows) == 10 and sum(r.kept for r in rows) == 7
    by = {(r.doc_id, r.kept): r for r in rows}
    assert by[1, True].group_size == 3 and by[2, False].keep_id == 1          # the longer original stays
    assert by[3, True].group_size == 2 and by[4, False].keep_id == 3          # null equals empty
    plain = re.sub(r"[\x20\x09-\x0D]", "", "One two  three four.")
    assert by[1, True].text_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns and left.count() == 7


def test_repeated_rows_leave_one(spark):
    twice = spark.createDataFrame([(5, "same"), (5, "same"), (5, "other")], "doc_id long, text string")
    assert sorted(r.text for r in exact_dedup.keep_one(twice).collect()) == ["other", "same"]


def test_token_files(docs, library):
    rows = token_file.round_trip(docs.sparkSession, docs, file_bytes=40_000).orderBy("start").collect()
    start = 0
    expected = {}
    for key, text in _texts(docs):
        expected.setdefault(key, []).append(np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4"))
    assert [r.doc_id for r in rows] == sorted((k for k, _ in _texts(docs)), key=lambda k: -1 if k is None else k)
    for r in rows:
        ids = expected[r.doc_id][0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_blocks_hold_outliers():
    rng = np.random.default_rng(0)
    for ids in (np.array([7], np.uint32), np.full(1300, 2**32 - 1, np.uint32), np.where(rng.random(3000) < .03, 2**31, rng.integers(0, 9, 3000)).astype(np.uint32)):
        blocks = token_file.pack_blocks(ids)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
        assert (token_file.unpack_blocks(b"".join(blocks), starts) == ids).all()


def test_bpe_equals_the_library(docs, library):
    coder = bpe.SegmentTreeBpe(word_bpe_path())
    odd = ["<|startoftext|>A<|endoftext|>", "a b c \x1c\x85", "İΣ ǅ é", "ab" * 900, "we'll 'S x²", "\x00\x7f"]
    for text in [t for _, t in _texts(docs)] + odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    found = {r.doc_id: r for r in bpe.encode_and_decode(docs).collect()}
    ids = library.encode("One two  three four.", add_special_tokens=False).ids
    assert found[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and found[3].n_tokens == 0


def test_packing(docs, library):
    rows = packing.pack(docs).toPandas()
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in _texts(docs))
    assert rows["length"].sum() == total and rows["length"].max() <= 4096
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert (sequence["offset"] == sequence["length"].cumsum() - sequence["length"]).all() and sequence["length"].sum() <= 4096
    assert rows["sequence_id"].nunique() == -(-total // 4096)


@pytest.mark.parametrize("score", ["residual", "dot"])
def test_every_capacity_holds(score):
    lengths = np.sort(np.random.default_rng(1).integers(1, 60, 500))[::-1]
    to, at = packing.vector_best_fit(lengths, 100, 4, 5000, score)
    for k in np.unique(to):
        own = lengths[to == k]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(int) ** 2).sum() <= 5000
        assert sorted(at[to == k]) == list(np.cumsum([0, *own[np.argsort(at[to == k])]])[:-1])


def test_sharding(docs):
    rows = sharding.assign(docs, 16).collect()
    assert len(rows) == 10 and all(r.grown_shard in (r.shard, 16) for r in rows)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sizes = np.bincount(sharding.jump(keys, 16))
    assert len(sizes) == 16 and sizes.min() > 1100 and (sharding.jump(keys, 1) == 0).all()


def _plain_print(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(docs):
    rows = simhash.near_groups(docs).collect()
    texts = dict(_texts(docs))
    assert len(rows) == 10 and all(r.fingerprint == f"{_plain_print(texts[r.doc_id]):016x}" for r in rows if len(texts[r.doc_id]) < 1000)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3
    assert simhash.keep_one(docs).columns == docs.columns


def test_links_join_the_same_pieces(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40)
    values = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for c in centres for _ in range(60)})
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, v in enumerate(values):
        for w in values[:k]:
            if (v ^ w).bit_count() <= 3:
                a, b = sorted((top(v), top(w)))
                parent[b] = a
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for tree in (1024, 20):  # the second splits its shards and meets tree by tree
        found = {r.node: r.root for r in simhash.roots(simhash.links(prints, 3, tree)).collect()}
        assert all(found.get(v, v) == top(v) for v in values)


def test_language(docs, spark):
    good = spark.createDataFrame([(k, ("the and of with that " if k % 2 else "der die und nicht ein ") * (1 + k % 7), "en" if k % 2 else "de") for k in range(80)],
                                 "doc_id long, text string, lang string")
    model = language.train(good)
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in language.predict(good, model).collect())
    by = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[3].score == 0 and by[6].lang_pred in ("en", "de")
    assert language.keep_known(docs, model).columns == docs.columns


def test_toxicity(docs, spark):
    texts = spark.createDataFrame([(k, "some plain words here " + ("idiot" if k % 4 == 0 else "friend") + f" w{k}") for k in range(400)], "doc_id long, text string")
    labels = texts.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS int) AS toxic")
    model = toxicity.train(texts, labels)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in toxicity.score(texts, model).collect())
    assert len(model.features) < 50
    assert toxicity.score(docs, model).count() == 10 and toxicity.keep_clean(docs, model).columns == docs.columns
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0.5}


def _plain_scores(texts, frequent, threshold, discount):
    tokens = {k: [*t.encode().lower().split(), None] for k, t in texts}
    held = {k: zlib.crc32(str(k if k is not None else "").encode()) % 10 == 0 for k in tokens}
    one, two, three = Counter(), Counter(), Counter()
    for k, w in tokens.items():
        if not held[k]:
            one.update(w), two.update(zip(w, w[1:])), three.update(zip(w, w[1:], w[2:]))
    total, states = sum(one.values()), {}
    for grams in (two, three):
        for gram, c in grams.items():
            context = gram[:-1]
            whole = one[context[0]] if len(context) == 1 else two[context]
            if c >= 2 and whole >= frequent:
                parent = one[gram[-1]] / total if len(context) == 1 else two[gram[1:]] / one[gram[1]]
                state = states.setdefault(context, [0, 0, 0, whole])
                state[0] += c * math.log((c - discount) / whole / parent)
                state[1] += c
                state[2] += 1
    kept = {}
    for context, (gain, seen, kinds, whole) in states.items():
        rest = 1 - (seen - discount * kinds) / whole
        if gain + (whole - seen) * math.log(max(rest, 1e-12)) > threshold:
            kept[context] = whole, rest
    out = {}
    for k, w in tokens.items():
        base = score = 0.0
        for t, word in enumerate(w):
            p = (one[word] + 0.1) / (total + 0.1 * (len(one) + 1))
            base += math.log10(p)
            for order, grams in ((1, two), (2, three)):
                context = tuple(w[t - order:t])
                if t >= order and context in kept:
                    whole, rest = kept[context]
                    c = grams[*context, word]
                    p = max(c - discount, 0) * (c >= 2) / whole + rest * p
            score += math.log10(p)
        out[k] = held[k], len(w), sum(one[x] > 0 for x in w), total, base, score
    return out


def test_suffix_tree(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        docs.where("doc_id > 2 AND doc_id < 9").selectExpr("doc_id + 900000 AS doc_id", "text"))
    plain = _plain_scores(_texts(table), 16, 6.0, 0.75)
    rows = suffix_tree.score(table).collect()
    assert len(rows) == len(plain) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == plain[r.doc_id][:4]
        assert (r.base_score, r.score) == pytest.approx(plain[r.doc_id][4:])


def test_suffix_tree_by_hashes_and_by_pairs_of_numbers(spark):
    """No context of three words is followed in texts of two, so that longer contexts, which have hashes, change nothing."""
    table = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "array_join(slice(split(text, ' '), 1, 2), ' ') AS text")
    pairs, hashes = ({r.doc_id: r.score for r in suffix_tree.score(table, depth=depth, threshold=1.0).collect()} for depth in (2, 3))
    base = {r.doc_id: r.base_score for r in suffix_tree.score(table, depth=1, threshold=1e9).collect()}
    assert hashes == pytest.approx(pairs) and pairs != pytest.approx(base)


def test_pairs_of_numbered_words_take_few_bytes_and_stay_apart():
    draw = np.random.default_rng(5)
    pairs = np.unique(draw.integers(0, 1 << 40, 200_000, dtype=np.uint64))
    keys = np.sort(suffix_tree._spread(pairs, 40))
    assert len(np.unique(keys)) == len(pairs) and int(keys.max()) < 1 << 40
    rows = list(suffix_tree._requests("b", keys, np.ones(len(keys)), 5, 40))
    assert (np.concatenate(suffix_tree._asked_keys(pd.DataFrame(rows, columns=["block", "shard", "keys", "sums"]))) == keys).all()
    sizes = [len(k) + len(s) for _, _, k, s in rows]
    assert len(rows) == 32 and max(sizes) < 1.2 * min(sizes) and sum(sizes) < 4 * len(keys)


def test_suffix_tree_with_a_bar_that_binds(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    low, high = (_plain_scores(_texts(table), bar, 6.0, 0.75) for bar in (16, 60))
    assert low != high
    for r in suffix_tree.score(table, frequent=60).collect():
        assert r.score == pytest.approx(high[r.doc_id][5])


def test_contexts_do_not_have_to_grow_with_the_corpus(spark):
    """A context met 16 times among 28 million tokens is tried like one among a thousand."""
    trained = [k for k in range(100) if zlib.crc32(str(k).encode()) % 10 != 0][:44]
    rows = [(k, "left right") for k in trained[:16]]
    long = spark.createDataFrame([(k,) for k in trained[16:44]], "doc_id long").selectExpr("doc_id", "repeat('a ', 1000000) AS text")
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(long)
    found = {r.doc_id: r for r in suffix_tree.score(table).collect()}
    assert found[trained[0]].train_tokens > 28_000_000
    assert found[trained[0]].score > found[trained[0]].base_score + 6


@pytest.mark.parametrize("run", [
    exact_dedup.exact_dedup, exact_dedup.keep_one, simhash.near_groups, simhash.keep_one, packing.pack, suffix_tree.score, bpe.encode_and_decode,
    lambda d: sharding.assign(d, 16), lambda d: token_file.round_trip(d.sparkSession, d), lambda d: language.predict(d, language.train(d))])
def test_empty_table(none, run):
    assert run(none).count() == 0


def test_what_a_block_tells_of_contexts_is_short_and_comes_back():
    rows = np.zeros((4, 1000))
    rows[:, 500:510] = [np.linspace(-3, 90, 10), np.arange(10) + 300, np.arange(10) + 1, np.arange(10) + 70_000]
    data = suffix_tree._gains_as_bytes(rows)
    told, back = suffix_tree._gains_from_bytes(data, 1000)
    assert len(data) < 300 and np.flatnonzero(told).tolist() == list(range(500, 510))
    assert all((a == b[500:510]).all() for a, b in zip(back, rows))
    told, back = suffix_tree._gains_from_bytes(suffix_tree._gains_as_bytes(rows[:, :3]), 3)
    assert not told.any() and not any(len(r) for r in back)
