"""Identifiers beyond 2^53 beside nulls, and operators against plain versions of their published methods."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from placegrid.llm import exact_dedup, language, packing, sharding, simhash, token_file, toxicity
from placegrid.llm.common import mix, word_hashes
from placegrid.llm.tokens import word_bpe_path

SF = "/root/testdata/sf0.001"
BIG = 2**60


@pytest.fixture(scope="module")
def wide(spark):
    """Large identifiers beside null ones, and columns named like those that the operators add."""
    rows = [(BIG + 1, "same text"), (None, "same text"), (BIG + 2, "sametext"), (BIG + 3, "another one " * 40), (None, None), (-BIG - 1, "word " * 9000), (BIG + 4, "")]
    rows += [(BIG + 100 + k, f"number {k} " * (k % 17)) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS __sum", "1 AS __points", "2 AS __n", "3 AS place", "4 AS deal").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe_path())


def _rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def _ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")


# --- identifiers ---------------------------------------------------------------------------------------------------

def _plain_kept(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), key is None, key or 0))
    return {plain: min(same) for plain, same in groups.items()}, {plain: len(same) for plain, same in groups.items()}


def test_exact_dedup_keeps_identifiers(wide):
    best, sizes = _plain_kept(_rows(wide))
    texts = {k: t for k, t in _rows(wide) if k is not None}
    for r in exact_dedup.exact_dedup(wide, fan_in=2).collect():
        plain = next(p for p in best if hashlib.sha256(p.encode()).hexdigest() == r.text_sha256)
        _, missing, key = best[plain]
        assert (r.keep_id, r.group_size) == (None if missing else key, sizes[plain]) and (r.doc_id is None or r.doc_id in texts)
    left = exact_dedup.keep_one(wide)
    assert left.columns == wide.columns and left.count() == len(best) and {r["__sum"] for r in left.collect()} == {"x"}


def test_token_files_keep_identifiers(wide, library):
    got = token_file.round_trip(wide.sparkSession, wide, file_bytes=4000).orderBy("start").collect()
    want = sorted(_rows(wide), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    whole = {k: _ids(library, t) for k, t in want if k is not None}
    assert all((r.n_tokens, r.ids_crc32) == (len(whole[r.doc_id]), zlib.crc32(whole[r.doc_id].tobytes())) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("deals", [2_000, 1])
def test_packing_equals_the_plain_pieces(wide, library, deals):
    got = packing.pack(wide, capacity=512, deal_sequences=deals).collect()
    pieces = sorted((k is not None, k or 0, n, first, len(cut), zlib.crc32(cut.tobytes())) for k, t in _rows(wide) for ids in [_ids(library, t)]
                    for n, first in enumerate(range(0, len(ids), 512)) for cut in [ids[first:first + 512]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 512
    assert len(sequences) <= -(-sum(r.length for r in got) // 512) + (0 if deals > 1 else 3)


# --- plain versions of published methods ---------------------------------------------------------------------------

def _plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding_equals_the_plain_version(wide):
    from pyspark.sql import functions as F

    keys = {r.doc_id: r.h & (2**64 - 1) for r in wide.select("doc_id", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("h")).collect()}
    texts = {}
    for k, t in _rows(wide):
        texts.setdefault(k, set()).add((len(t.encode()) + 1, zlib.crc32(t.encode())))
    for r in sharding.assign(wide, 16).collect():
        assert (r.shard, r.grown_shard, r.law) == (_plain_jump(keys[r.doc_id], 16), _plain_jump(keys[r.doc_id], 17), "key")
        assert (r.size, r.text_crc32) in texts[r.doc_id]


def _plain_features(text):
    data = text.encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", data)]
    hashes = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    mixed = lambda v: int(mix(np.array([v & (2**64 - 1)], np.uint64))[0]) >> (64 - toxicity.BITS)
    found = {mixed(h) for h in hashes}
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        found |= {mixed(a * 0x9E3779B97F4A7C15 + b + salt) for a, b in zip(hashes, hashes[gap:])}
    return found


def _plain_ftrl(examples, labels, alpha=4.0, beta=1.0, l1=6.0, l2=1.0, rounds=4, seed=7):
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0
    rng = np.random.default_rng(seed)

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(rounds):
        for k in rng.permutation(len(examples)):
            bias = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
            w = {f: weight(f) for f in examples[k]}
            miss = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - labels[k]
            for f, v in w.items():
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + miss - (math.sqrt(old + miss * miss) - math.sqrt(old)) / alpha * v
                n[f] = old + miss * miss
            bias_z += miss - (math.sqrt(bias_n + miss * miss) - math.sqrt(bias_n)) / alpha * bias
            bias_n += miss * miss
    return {f: weight(f) for f in z if weight(f)}, -bias_z / ((beta + math.sqrt(bias_n)) / alpha)


def test_toxicity_equals_the_plain_version(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(table, labels)
    texts = dict(_rows(table))
    marks = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts}
    known = sorted(((mark, sorted(_plain_features(texts[k]))) for k, mark in marks.items()), key=lambda e: (e[0], np.array(e[1], np.int32).tobytes()))
    weights, bias = _plain_ftrl([f for _, f in known], [m for m, _ in known])
    assert len(known) < toxicity.TRAIN_ROWS and set(model.features.tolist()) == set(weights) and model.bias == pytest.approx(bias)
    assert dict(zip(model.features.tolist(), model.weights)) == pytest.approx(weights)
    for r in toxicity.score(table, model).collect()[:200]:
        total = sum(weights.get(f, 0.0) for f in _plain_features(texts[r.doc_id])) + bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))) and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_equals_the_plain_version(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(table)
    texts = dict(_rows(table))
    for r in language.predict(table, model).collect():
        text = texts[r.doc_id]
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        vectors = np.concatenate([model.table[b] for b, _ in language.subwords(data, np.array([0, len(data)]))]).astype(np.float64)
        logits = (vectors.mean(axis=0) + model.bias) / model.temperature
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        assert r.score == pytest.approx(chance.max(), rel=1e-6) and r.lang_pred == model.languages[int(chance.argmax())]
        assert r.rejected == (r.score < model.threshold)


def test_fingerprints_of_long_texts_are_taken_in_steps():
    import xxhash

    from placegrid.llm.simhash import fingerprint

    words = " ".join(f"w{k % 37}x{k % 11}" for k in range(600)).encode()
    cut = words.split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(cut[k:k + 3]), 42) for k in range(len(cut) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {int(fingerprint(words, step=s)) & (2**64 - 1) for s in (5, 64, 65_536)} == {want}


# --- the pipeline --------------------------------------------------------------------------------------------------

def test_every_stage_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda table: {r.doc_id for r in table.select("doc_id").collect()}
    toxic = toxicity.train(docs, labels)
    clean = stages["toxicity"](spark, docs, SF)
    weights = dict(zip(toxic.features.tolist(), toxic.weights))
    total = {k: sum(weights.get(f, 0.0) for f in _plain_features(t)) + toxic.bias for k, t in _rows(docs)}
    assert kept(clean) == {k for k, v in total.items() if 1 / (1 + math.exp(-v)) < 0.7}
    known = stages["language"](spark, clean, SF)
    assert kept(known) == {r.doc_id for r in language.predict(clean, language.train(clean)).collect() if not r.rejected}
    once = stages["exact_dedup"](spark, known, SF)
    best, _ = _plain_kept(_rows(known))
    assert kept(once) == {key for _, _, key in best.values()}


def test_pipeline_of_an_empty_table(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    left = toxicity.keep_clean(none, toxicity.train(none, labels))
    for name, stage in corpus_pipeline.STAGES[1:]:
        left = stage(spark, left, SF)
        assert left.count() == 0, name
