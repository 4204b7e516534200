"""The queries of this subpackage and the SQL they are checked against, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from placegrid.llm import bpe, divergence, exact_dedup, language, nearest, packing, quality, sharding, simhash, suffix_tree, token_file, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return keep


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("op1_exact_dedup", r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
      FROM documents),
    best AS (
      SELECT plain, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY plain)
    SELECT d.doc_id, best.keep_id, best.group_size, d.doc_id = best.keep_id AS kept, sha256(d.plain) AS text_sha256
    FROM d JOIN best USING (plain)""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


@_query("op9_jump_shards")
def op9_jump_shards(spark, sf_dir):
    return sharding.assign(_documents(spark, sf_dir), shards=16)


@_query("op3_token_files")
def op3_token_files(spark, sf_dir):
    return token_file.round_trip(spark, _documents(spark, sf_dir))


@_query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


@_query("op6_segment_tree_bpe")
def op6_segment_tree_bpe(spark, sf_dir):
    return bpe.encode_and_decode(_documents(spark, sf_dir))


@_query("op4_language")
def op4_language(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return language.predict(docs, language.train(docs))


@_query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_query("op2_simhash")
def op2_simhash(spark, sf_dir):
    return simhash.near_groups(_documents(spark, sf_dir))


@_query("op5_multi_index")
def op5_multi_index(spark, sf_dir):
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@_query("op10_suffix_tree")
def op10_suffix_tree(spark, sf_dir):
    return suffix_tree.score(_documents(spark, sf_dir))


@_query("op13_source_divergence", r"""
    WITH d AS (
      SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS place
      FROM documents),
    words AS (
      SELECT lang, source, place, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM (SELECT lang, source, place, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d)),
    known AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT place) >= 3),
    kinds AS (SELECT lang, count(*) AS v FROM known GROUP BY lang),
    kept AS (
      SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN known k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
    grp AS (
      SELECT g.lang, g.source, coalesce(s.own, 0) AS own, coalesce(k.v, 0) AS v
      FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN kinds k ON k.lang = g.lang
      LEFT JOIN (SELECT lang, source, sum(n) AS own FROM kept GROUP BY lang, source) s ON s.lang = g.lang AND s.source = g.source),
    whole AS (SELECT lang, sum(own) AS own FROM grp GROUP BY lang),
    shares AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.own + g.v) AS BIGINT) AS p,
             CAST(1 + (1000000000 * (k.total + 1)) // (w.own + g.v) AS BIGINT) AS q
      FROM grp g JOIN known k ON k.lang = g.lang JOIN whole w ON w.lang = g.lang
      LEFT JOIN kept c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
    found AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
    WHERE part = 'pair' OR rank <= 200""")
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(_documents(spark, sf_dir))


@_query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query("op11_quality")
def op11_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
