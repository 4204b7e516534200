"""How far the sources of a language are apart in the words they use, by cube partitioning.

Every (language, source) group gives each kept term of its language a share. The groups of a language are dealt into
blocks, its terms likewise, and a task owns a cell (group block, group block, term block): it gets the two slices of
shares, which are sent to every cell that needs them, and adds up the divergences of its pairs of groups over its terms.
The sums are then reduced along the term axis. No task holds a whole group, a whole language or all terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from placegrid.session import materialize

#: Groups and terms of a block, on average; memory of a cell is at most twice their product.
GROUPS, TERMS = 32, 8192
#: Entries (group, term) that a counting task holds before it sends them on, and bytes of a text that it cuts at a time.
ENTRIES, CUT = 400_000, 8 << 20

#: ASCII letters in lower case and all bytes beyond ASCII; everything else parts terms.
_TERM = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes):
    """Lists of the terms of a text, a bounded part of it at a time, repeats included."""
    first = 0
    while first < len(text):
        last = first + CUT
        if last < len(text):  # a term is not cut
            while last < len(text) and _TERM[text[last]] != 32:
                last += 1
        yield text[first:last].translate(_TERM).split()
        first = last


def _counts(batches):
    """Occurrences and documents of each (lang, source, term), added up as far as ``ENTRIES`` allows."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def found():
        parts = []
        for (lang, source), (seen, docs) in groups.items():
            terms = list(seen)
            parts.append(pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(list(map(seen.__getitem__, terms)), pa.int64()), pa.array(list(map(docs.__getitem__, terms)), pa.int64())],
                names=["lang", "source", "term", "n", "docs"]))
        groups.clear()
        return parts

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            seen, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for some in terms_of(text.as_py()):
                seen.update(some)
                own.update(some)
            docs.update(own)
            if len(own) > 1000 or len(groups) > 1000:
                if sum(len(s) for s, _ in groups.values()) > ENTRIES or len(groups) > ENTRIES:
                    yield from found()
        if sum(len(s) for s, _ in groups.values()) > ENTRIES:
            yield from found()
    yield from found()


def _whole_part(above: Column, below: Column) -> Column:
    return F.call_function("div", above, below)


def share(count: Column, whole: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (whole + kinds)) in whole numbers, three digits at a time, so that nothing overflows."""
    below, rest = whole + kinds, count + F.lit(1)
    digits, left = _whole_part(rest, below), rest % below
    for _ in range(3):
        left = left * F.lit(1000)
        digits, left = digits * F.lit(1000) + _whole_part(left, below), left % below
    return digits + F.lit(1)


def apart(p, q):
    """floor((p - q)^2 / q), for columns or arrays of whole numbers."""
    if isinstance(p, Column):
        return _whole_part((p - q) * (p - q), q)
    return (p - q) ** 2 // q


def _one_way(p: np.ndarray, p0: np.ndarray, p_has: np.ndarray, q: np.ndarray, q0: np.ndarray, q_has: np.ndarray) -> np.ndarray:
    """Sum over the terms of the divergence of each row of ``p`` from each row of ``q``.

    A term that a group lacks has its share ``p0`` (``q0``). So all terms of ``p`` are first taken as lacking, which
    needs the terms that ``q`` has only, and then the terms that ``p`` has are put right.
    """
    rows, cols = np.nonzero(q_has)
    stored, kinds = q[rows, cols], q_has.sum(axis=1)
    out = np.empty((len(p), len(q)), np.int64)
    for g in range(len(p)):
        added = np.zeros(len(q), np.int64)
        np.add.at(added, rows, apart(p0[g], stored))
        added += (q.shape[1] - kinds) * apart(p0[g], q0)
        own = np.flatnonzero(p_has[g])
        other = q[:, own]
        out[g] = added + (apart(p[g, own][None, :], other) - apart(p0[g], other)).sum(axis=1)
    return out


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Divergences of all pairs of two group blocks over one term block, both ways; pairs within a block once each way.

    A row without a term marks a group and has the share of terms that the group lacks.
    """
    marks = pdf[pdf["term"].isna()].sort_values("source")
    names, block, zero = marks["source"].to_numpy(), marks["block"].to_numpy(), marks["p"].to_numpy()
    rows = pdf[pdf["term"].notna()]
    col, distinct = pd.factorize(rows["term"])
    row = pd.Index(names).get_indexer(rows["source"])
    shares = np.repeat(zero[:, None], len(distinct), axis=1)
    has = np.zeros(shares.shape, bool)
    shares[row, col], has[row, col] = rows["p"].to_numpy(), True
    a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
    parts = []
    for left, right in ((a, b), (b, a)) if a != b else ((a, a),):
        i, j = np.flatnonzero(block == left), np.flatnonzero(block == right)
        if len(distinct):
            sums, none = _one_way(shares[i], zero[i], has[i], shares[j], zero[j], has[j]), apart(zero[i][:, None], zero[j][None, :])
        else:
            sums = none = np.zeros((len(i), len(j)), np.int64)
            if (zero > 0).all():
                none = apart(zero[i][:, None], zero[j][None, :])
        parts.append(pd.DataFrame({"source": np.repeat(names[i], len(j)), "item": np.tile(names[j], len(i)), "sum": sums.ravel(), "none": none.ravel()}))
    out = pd.concat(parts)
    out = out[out["source"] != out["item"]]
    out["lang"], out["kinds"] = pdf["lang"].iloc[0], len(distinct)
    return out[["lang", "source", "item", "sum", "none", "kinds"]]


def audit(docs: DataFrame, top: int = 200, least_docs: int = 3, groups: int = GROUPS, terms: int = TERMS,
          lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each group is from the others of its language, and by which terms.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the group uses more than
    its language does. A null text, language or source counts as ''. A term is kept in a language if ``least_docs`` of
    its rows hold it; repeated rows count each. Groups without terms take part with counts of zero; where a language
    keeps no term all its pairs have the value 0. Ties go to the item that is smaller in UTF-8. An empty table gives no
    rows; other columns are ignored. All arithmetic is in whole numbers: counts to 9e15, values to 9.2e18.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = materialize(plain.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
                         .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    known = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
                        .where(F.col("docs") >= least_docs).drop("docs"))
    kept = materialize(counts.drop("docs").join(known, ["lang", "term"]))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    listed = plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    listed = materialize(listed)
    langs = (listed.groupBy("lang").agg(F.count(F.lit(1)).alias("many"), F.sum("own").alias("whole"))
             .join(known.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds")), "lang", "left")
             .select("lang", "whole", F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"),
                     F.ceil(F.col("many") / F.lit(groups)).cast("int").alias("group_blocks"),
                     F.greatest(F.lit(1), F.ceil(F.coalesce("kinds", F.lit(0)) / F.lit(terms))).cast("int").alias("term_blocks")))
    named = materialize(listed.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int")))

    entries = kept.join(named, ["lang", "source"])
    p = share(F.col("n"), F.col("own"), F.col("kinds"))
    slices = entries.select("lang", "source", "block", "group_blocks", "term", p.alias("p"),
                            F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("slice"))
    lacking = F.when(F.col("kinds") > 0, share(F.lit(0).cast("long"), F.col("own"), F.when(F.col("kinds") > 0, F.col("kinds")))).otherwise(F.lit(0))
    marks = named.select("lang", "source", "block", "group_blocks", F.lit(None).cast("string").alias("term"), lacking.cast("long").alias("p"),
                         F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("slice"))
    sent = slices.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    cells = (sent.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
             .groupBy("lang", "a", "b", "slice").applyInPandas(_cell, "lang string, source string, item string, sum long, none long, kinds long"))
    pairs = (cells.groupBy("lang", "source", "item").agg(F.sum("sum").alias("sum"), F.max("none").alias("none"), F.sum("kinds").alias("met"))
             .join(langs.select("lang", "kinds"), "lang")
             .select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("sum") + (F.col("kinds") - F.col("met")) * F.col("none")).alias("value")))

    q = share(F.col("total"), F.col("whole"), F.col("kinds"))
    over = entries.select("lang", "source", "term", p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    words = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    turn = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    first = words.withColumn("rank", turn).where(F.col("rank") <= top)
    return pairs.withColumn("rank", turn).unionByName(first)
