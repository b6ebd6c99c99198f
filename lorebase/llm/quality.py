"""Operator 9: quality rules with host-level verdicts.

Base features and rules are per document. For every rule the failures of a host are counted, and its failure rate is
shrunk by an empirical beta prior: the prior's two parameters come from mean and variance of the rates of all hosts
(method of moments; where hosts vary no more than chance allows, the prior weighs as much as one document). A host
fails when the shrunk rate of some rule exceeds HOST_LIMIT; its documents are not kept. Documents that fail a base
rule are not kept either.

Counts are pre-aggregated on the map side, so a host with a third of all documents costs no more than others; the
verdicts are joined to narrow feature rows, where AQE splits a skewed host. The prior is one row.

A null text has no words and fails the length rule. A null host is a host of its own. Rows are kept one to one, those
of null doc_id and repeated ones too, so ties need no rule; an empty table gives no rows. Very long texts are hashed in
stretches of bounded size, and extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, hash_each, map_arrow, raw_shingles, save, text_bytes

HOST_LIMIT = 0.5
MIN_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, DUP_LINES_PERCENT = 50, 50, 10, 30
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {SYMBOL_PERCENT} * word_chars",
    "dup_lines": f"100 * n_dup_lines > {DUP_LINES_PERCENT} * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(text: bytes | None, words: np.ndarray) -> tuple[int, int, int, int, int, int]:
    if not text:
        return (0,) * 6
    chars = len(text.translate(None, _CONTINUATION + _SPACE))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    repeated = 0
    if len(words) >= 3:
        windows = raw_shingles(words, 3)
        _, of, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[of] >= 2
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : i + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def document_features(docs: DataFrame, host_col: str = "source") -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string())] + [(f, pa.int64()) for f in FEATURES])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(2).to_pylist()
            found = np.array([features(t, w) for t, w in zip(texts, hash_each(texts, lower=False), strict=True)], np.int64).reshape(-1, len(FEATURES))
            yield batch(schema, b.column(0), b.column(1), *found.T)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_bytes("text").alias("text"))
    return map_arrow(rows, run, "doc_id long, host string, " + ", ".join(f"{f} long" for f in FEATURES))


def host_verdicts(scored: DataFrame) -> DataFrame:
    """host, n_docs, rate_<rule> (shrunk), host_failed; from rows with host and fails_<rule>."""
    hosts = scored.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES])
    prior = hosts.agg(*[x for r in RULES for x in (F.avg(F.col(r) / F.col("n_docs")).alias(f"m_{r}"), F.var_pop(F.col(r) / F.col("n_docs")).alias(f"v_{r}"))])
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when((v > 0) & (m * (1 - m) > v), m * (1 - m) / v - 1).otherwise(1.0)
        out = out.withColumn(f"rate_{r}", (F.col(r) + m * weight) / (F.col("n_docs") + weight))
    failed = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > HOST_LIMIT
    return out.select("host", "n_docs", *[f"rate_{r}" for r in RULES], failed.alias("host_failed"))


def quality(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, features, fails_<rule>, base_failed, host_failed, kept."""
    f = save(document_features(docs, host_col), "features")
    scored = f.select("*", *[F.expr(e).alias(f"fails_{r}") for r, e in RULES.items()])
    verdicts = host_verdicts(scored).select(F.col("host").alias("h"), "host_failed")
    joined = scored.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    base = F.col("fails_short") | F.col("fails_repeats")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce("host_failed", F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *FEATURES[:5], "base_failed", "kept")


def _oracle() -> str:
    rates = ", ".join(f"avg(f_{r} / n) AS m_{r}, var_pop(f_{r} / n) AS v_{r}" for r in RULES)
    weight = lambda r: f"CASE WHEN v_{r} > 0 AND m_{r} * (1 - m_{r}) > v_{r} THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE 1.0 END"
    shrunk = ", ".join(f"(f_{r} + m_{r} * ({weight(r)})) / (n + ({weight(r)}))" for r in RULES)
    space = "[\\x20\\x09-\\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c >= 2),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
f AS (SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
s AS (SELECT *, {", ".join(f"({e}) AS fails_{r}" for r, e in RULES.items())} FROM f),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (WHERE fails_{r}) AS DOUBLE) AS f_{r}" for r in RULES)} FROM s GROUP BY host),
m AS (SELECT {rates} FROM h),
v AS (SELECT host, greatest({shrunk}) > {HOST_LIMIT} AS host_failed FROM h, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails_short OR fails_repeats AS base_failed,
  NOT (fails_short OR fails_repeats) AND NOT host_failed AS kept FROM s JOIN v ON v.host IS NOT DISTINCT FROM s.host
"""


ORACLE = _oracle()
