"""The quality classifier, whitening and the divergence audit against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from placegrid.llm import divergence, quality, whitening
from placegrid.llm.spectrum import Spectrum, rank_one

SF = "/root/testdata/sf0.001"


# --- divergence ----------------------------------------------------------------------------------------------------

def _plain_audit(rows, top=200):
    docs = [(l or "", s or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for l, s, t in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(l, s, [w.translate(lower) for w in words]) for l, s, words in docs]
    out = set()
    for lang in {l for l, _, _ in docs}:
        seen = Counter(w for l, _, words in docs if l == lang for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= 3)
        groups = {s: Counter() for l, s, _ in docs if l == lang}
        for l, s, words in docs:
            if l == lang:
                groups[s].update(w for w in words if seen[w] >= 3)
        whole = sum(groups.values(), Counter())

        def share(counts):
            return {w: 1 + 10**9 * (counts[w] + 1) // (sum(counts.values()) + len(kept)) for w in kept}

        shares, q = {s: share(c) for s, c in groups.items()}, share(whole)

        def ranked(source, part, found):
            for rank, (value, item) in enumerate(sorted(((v, i) for i, v in found), key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item, value, rank))

        for s, p in shares.items():
            ranked(s, "pair", [(o, sum((p[w] - r[w]) ** 2 // r[w] for w in kept)) for o, r in shares.items() if o != s])
            ranked(s, "term", [(w, (p[w] - q[w]) ** 2 // q[w]) for w in kept if groups[s][w] and p[w] > q[w]])
    return out


@pytest.mark.parametrize("groups, terms", [(32, 8192), (3, 40)])
def test_audit_equals_the_plain_version(spark, docs, groups, terms):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").unionByName(docs.select("lang", "source", "text"))
    table = table.unionByName(spark.createDataFrame([("xx", "a", "one"), ("xx", "b", None), ("xx", None, "two"), ("fr", "only", "Été ÉTÉ x_y")],
                                                    "lang string, source string, text string")).selectExpr("*", "'x' AS term", "1 AS n", "2 AS block")
    rows = [tuple(r) for r in divergence.audit(table, groups=groups, terms=terms).collect()]
    want = _plain_audit([(r.lang, r.source, r.text) for r in table.collect()])
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert ("xx", "a", "pair", "b", 0, 2) in want and len({r[:2] for r in rows if r[0] == "xx"}) == 3


def test_terms_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "CUT", 5)
    text = "Abcdefghij klm é9ö NOP".encode()
    assert [w.decode() for some in divergence.terms_of(text) for w in some] == ["abcdefghij", "klm", "é", "ö", "nop"]
    assert list(divergence.terms_of(b"")) == []


def test_shares_do_not_overflow(spark):
    count, whole, kinds = 8 * 10**14, 9 * 10**14, 12345
    got = spark.range(1).select(divergence.share(*[divergence.F.lit(v).cast("long") for v in (count, whole, kinds)])).first()[0]
    assert got == 1 + 10**9 * (count + 1) // (whole + kinds)


# --- whitening -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["plain", "repeated", "equal", "wide", "flat"])
def test_spectra_by_rank_one_updates(kind):
    rng, d = np.random.default_rng(2), 24
    rows = {"plain": rng.normal(size=(300, d)), "repeated": np.repeat(rng.integers(-3, 3, (4, d)), 9, axis=0).astype(float), "equal": 7 * np.eye(d),
            "wide": rng.normal(size=(200, d)) * 10.0 ** np.linspace(-5, 5, d), "flat": np.ones((5, d))}[kind]
    one, two, single = Spectrum(d), Spectrum(d), Spectrum(d)
    one.add_rows(rows[:len(rows) // 3]), two.add_rows(rows[len(rows) // 3:])
    one.merge(two.rows, two.mean, two.values, two.vectors)
    for row in rows:
        single.merge(1, row, np.zeros(d), np.eye(d))
    centred = rows - rows.mean(axis=0)
    want = np.linalg.eigvalsh(centred.T @ centred)
    for found in (one, single):
        assert found.rows == len(rows) and np.allclose(found.mean, rows.mean(axis=0))
        assert np.abs(found.values - want).max() <= 1e-10 * max(want.max(), 1)
        assert np.abs(found.vectors.T @ found.vectors - np.eye(d)).max() < 1e-10
        assert np.abs(centred.T @ centred @ found.vectors - found.vectors * found.values).max() <= 1e-9 * max(want.max(), 1)


def test_a_row_of_zeros_changes_nothing():
    values, vectors = rank_one(np.arange(3.0), np.eye(3), np.zeros(3))
    assert (values == np.arange(3)).all() and (vectors == np.eye(3)).all()


def _plain_white(rows):
    kept = [(k, np.floor(256 * np.array(v, float)).astype(int)) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k, x in kept:
        white = (x - sums / n) @ vectors[:, :4] / np.sqrt(values[:4])
        out.setdefault(k, []).append((int(((n * x - sums) ** 2).sum()), np.abs(white), values[:4] / values.sum()))
    return n, out


def test_whitening_equals_the_plain_version(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(900001, None), (900002, [None] * 64), (900003, [float("nan")] * 64), (900004, [float("inf")] * 64), (None, [0.25] * 64),
                                 (900005, [1.0] * 3), (2**60 + 1, [-0.0] * 64), (900006, []), (7, [0.25] * 64)], "vec_id long, embedding array<float>")
    table = table.unionByName(bad).unionByName(table.limit(30)).repartition(5).selectExpr("*", "1 AS id", "'y' AS x", "2 AS n")
    rows = whitening.whiten(table).collect()
    n, want = _plain_white([(r.vec_id, r.embedding) for r in table.collect() if r.embedding is None or len(r.embedding) == 64])
    assert len(rows) == 4 * sum(map(len, want.values())) and {2**60 + 1, None} <= {r.vec_id for r in rows}
    for r in rows:
        white, share = next((w, s) for d, w, s in want[r.vec_id] if d == r.deviation)
        assert r.n == n and abs(r.explained - share[r.component - 1]) < 1e-12
        assert abs(abs(r.whitened) - white[r.component - 1]) < 1e-8 and r.identity_error < 1e-9
    assert sum(r.vec_id == 7 for r in rows) == 4 * len(want[7])


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_exact_sums_and_deviations():
    rows = np.array([[2**40, -5], [2**40 + 3, 7]])
    sums = [int(c) for c in rows.sum(axis=0)]
    assert whitening.deviations(rows, 2, sums) == [sum((2 * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in rows]
    assert whitening.deviations(np.array([[2**50]]), 10**6, [0]) == [None]
    high, low = whitening._carried((rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0))
    assert [int(h) * 2**32 + int(l) for h, l in zip(high, low)] == sums


# --- quality -------------------------------------------------------------------------------------------------------

def _plain_statistics(text):
    data = text.encode()
    points, gaps = ".,;:?'\"()-", " \t\n\x0b\x0c\r"
    upper = sum(65 <= b <= 90 for b in data)
    digits, beyond = sum(48 <= b <= 57 for b in data), sum(b >= 128 for b in data)
    dots, blanks = sum(chr(b) in points for b in data), sum(chr(b) in gaps for b in data)

    def mark(b):
        return 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in points

    words, lines = data.split(), [line for line in data.split(b"\n") if line]
    letters = [[65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w] for w in words]
    lengths = [len(w) for w in words]
    mean = sum(lengths) / max(len(words), 1)
    size = Counter(data)
    odds = lambda a, n: np.log((a + .5) / (n - a + .5))
    return [np.log1p(len(data)), np.log1p(len(words)), odds(upper, len(data)), odds(beyond, len(data)), odds(digits, len(data)), odds(dots, len(data)),
            odds(sum(map(mark, data)), len(data)), odds(blanks, len(data)),
            odds(sum(mark(w[0]) or mark(w[-1]) for w in words), len(words)),
            odds(sum(sum(65 <= b <= 90 for b in w) > 1 and not any(97 <= b <= 122 for b in w) for w in words), len(words)),
            odds(sum(not any(x) for x in letters), len(words)),
            odds(sum(a.lower() == b.lower() for a, b in zip(words, words[1:])), len(words)), odds(len({w.lower() for w in words}), len(words)),
            np.log1p(mean), np.log1p(np.sqrt(sum((n - mean) ** 2 for n in lengths) / max(len(words), 1))),
            odds(len({line.lower() for line in lines}), len(lines)), np.log1p(len(data) / max(len(lines), 1)),
            -sum(n / len(data) * np.log(n / len(data)) for n in size.values())]


def test_statistics_equal_the_plain_version(docs):
    texts = [r.text or "" for r in docs.collect()] + ["ÉTÉ $$x A&&& bb bb BB\n\nbb\tcc!!", "ABC DEF 12 12\nline\nline", " "]
    found = quality.statistics(pa.array(texts))
    assert found.shape == (len(texts), quality.STATISTICS)
    for row, text in zip(found, texts):
        assert row == pytest.approx(_plain_statistics(text))


def test_densities_are_those_of_two_gaussians():
    rng = np.random.default_rng(4)
    rows, marks = np.concatenate([rng.normal(size=(60, 3)) * [1, 2, 3], rng.normal(size=(90, 3)) + 1]), np.repeat([0, 1], [60, 90])
    model = quality._densities(rows, marks, 0.3, 0.1)
    scaled = (rows - rows.mean(axis=0)) / rows.std(axis=0)
    parts = [scaled[marks == k] for k in (0, 1)]
    both = sum(len(p) * np.cov(p.T, bias=True) for p in parts) / 150
    logs = []
    for p in parts:
        cov = quality.shrunk(np.cov(p.T, bias=True), both, 0.3, 0.1)
        away = scaled - p.mean(axis=0)
        logs.append(np.log(len(p) / 150) - np.linalg.slogdet(cov)[1] / 2 - (away * np.linalg.solve(cov, away.T).T).sum(axis=1) / 2)
    assert model.difference(rows) == pytest.approx(logs[1] - logs[0])


def test_quality(spark, docs):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(table, labels)
    rows = quality.score(table, model).join(labels, "doc_id").collect()
    aside = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    assert len(aside) > 80 and sum(r.predicted == r.quality for r in aside) / len(aside) > 0.96
    again = quality.train(table.repartition(7), labels.repartition(3))
    assert again.slope == pytest.approx(model.slope)
    scored = quality.score(docs, model).collect()
    assert len(scored) == 10 and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.score(docs, quality.train(table, labels.where("false"))).collect()} == {0.5}
    held = quality.train(table, labels.where("crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2"))
    assert held is None  # held-out labels teach nothing


def test_empty_tables(none, spark):
    assert divergence.audit(none).count() == 0
    assert quality.score(none, quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
