"""Operator 12: fill-in-middle transformation; texts are cut at token borders and their middle is moved to the end.

Tokens are what a Split pre-tokenizer of the tokenizers library isolates by PATTERN; nothing is trained. Its code-point
offsets give the number n of tokens and the places of the two cuts, which are drawn from a hash of the id alone: with
h1 to h4, the first four 32-bit words of the SHA-256 of "seed:id", prefix and middle end behind the smaller and the larger
of h1 % (n + 1) and h2 % (n + 1) tokens. A space is always a token, so each distinct
run between spaces is split once and remembered, up to a bound; long runs are split a stretch at a time, cut where a letter
does not follow. Only the text goes to Python and three numbers come back; outputs are put together, and taken apart, by Spark.

Forms: plain (the text) where the text is empty or holds one of the three marks, or for a share of all; else spm or psm.
Since the text holds no mark, and none can begin within one and end behind it, the first <S>, <P> and <M> behind the
leading mark are the ones put there, so `restored` is exact.

A null text is an empty one. Bytes that are no UTF-8 become U+FFFD first. A null id is hashed as an empty one; rows
with equal ids are cut by the same draws. An empty table gives no rows. Extra columns are kept; columns called like a
result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, fresh, quoted

PATTERN = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
#: Shares, of 100, of transformed texts, and among them of suffix-prefix-middle.
TRANSFORMED, SPM = 90, 20
#: Code points that are split at a time; of runs that a task remembers.
STRETCH, CACHE = 1 << 16, 1 << 25
_LETTERS = re.compile("[A-Za-z]*")


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """(start, piece) of pieces of about `size` code points that end where no token does go on."""
    at = 0
    while at < len(text):
        end = _LETTERS.match(text, min(len(text), at + size)).end()
        yield at, text[at:end]
        at = end


def token_ends(split, text: str, size: int = STRETCH) -> np.ndarray:
    """The offset behind each token, in code points."""
    ends = [np.fromiter((e for _, (_, e) in split.pre_tokenize_str(piece)), np.int64) + at for at, piece in stretches(text, size)]
    return np.concatenate([np.zeros(0, np.int64), *ends])


class Splitter:
    """Token borders of texts. The library splits each distinct run between spaces once; a space is a token of its own."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(PATTERN), behavior="isolated")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ends: list[tuple[int, ...]] = []
        self.held = 0

    def _learn(self, runs: list[str]) -> None:
        """New runs are split together, one space apart."""
        ends = token_ends(self.split, " ".join(runs))
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        start = np.cumsum(size + 1) - size - 1
        first, last = (np.searchsorted(ends, at, side="right").tolist() for at in (start, start + size))
        flat = ends.tolist()
        for run, s, i, j in zip(runs, start.tolist(), first, last, strict=True):
            self.place[run] = len(self.ends)
            self.ends.append(tuple([e - s for e in flat[i:j]]))
        self.held += int(size.sum()) + 64 * len(runs)

    def cuts(self, text: str, first: int, second: int) -> tuple[int, int, int]:
        """(tokens, end of the prefix, end of the middle) for two draws."""
        if not text:
            return 0, 0, 0
        if self.held > CACHE:
            self.forget()
        runs = text.split(" ")
        if new := set(runs).difference(self.place):
            self._learn(list(new))
        which = np.fromiter(map(self.place.__getitem__, runs), np.int64, len(runs))
        # with the space behind each run, which the last one lacks
        tokens = np.cumsum(np.fromiter(map(len, map(self.ends.__getitem__, which.tolist())), np.int64, len(runs)) + 1)
        n = int(tokens[-1]) - 1

        def end(rank: int) -> int:
            """The offset behind so many tokens."""
            if not rank:
                return 0
            k = int(np.searchsorted(tokens, rank))
            nth = rank - (int(tokens[k - 1]) if k else 0)
            ends = self.ends[which[k]]
            return sum(map(len, runs[:k])) + k + (ends[nth - 1] if nth <= len(ends) else len(runs[k]) + 1)

        a, b = sorted((first % (n + 1), second % (n + 1)))
        return n, end(a), end(b)


def _cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    splitter = Splitter()
    for texts, first, second in parts:
        rows = [splitter.cuts(*row) for row in zip(texts, first, second, strict=True)]
        yield pd.DataFrame(rows, columns=["n", "a", "b"], dtype="int64")


RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, id_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """docs with n (long), form, prefix_chars, middle_chars (long, null if plain) and output."""
    configure(docs.sparkSession)
    keep = quoted([c for c in docs.columns if c.lower() not in RESULTS])
    whole, draw, cut = (fresh(c, [*docs.columns, *RESULTS]) for c in ("_text", "_draw", "_cut"))
    text, hex_ = F.col(whole), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col(draw), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(*keep, F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit("")).alias(whole), hex_.alias(draw))
    rows = rows.withColumn(cut, F.pandas_udf(_cut, "n long, a long, b long")(text, h[0], h[1]))
    a, b = F.col(cut)["a"], F.col(cut)["b"]
    plain = (text == "") | (h[2] % 100 >= TRANSFORMED)
    for m in MARKS:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain, "plain").when(h[3] % 100 < SPM, "spm").otherwise("psm")
    rows = rows.select(*keep, whole, F.col(cut)["n"].alias("n"), form.alias("form"), F.when(~plain, a).alias("prefix_chars"), F.when(~plain, b - a).alias("middle_chars"))
    a, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), a), F.substr(text, a + 1, m), F.substr(text, a + m + 1)
    p, s, mid = map(F.lit, MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, mid, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, mid, middle)).otherwise(text)
    return rows.select(*keep, *RESULTS[:4], output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    p, s, m = MARKS

    def behind(second: str) -> tuple[Column, Column, Column]:
        """What stands behind the leading mark, behind `second` and behind the last mark."""
        i = F.instr(output, F.lit(second))
        rest = F.substr(output, i + len(second))
        j = F.instr(rest, F.lit(m))
        return F.substr(output, F.lit(4), i - 4), F.substr(rest, F.lit(1), j - 1), F.substr(rest, j + len(m))

    prefix, suffix, middle = behind(s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = behind(p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS hex FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, [CAST('0x' || substr(hex, 1 + 8 * k, 8) AS BIGINT) for k in [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole document, transformed and restored, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = restored(F.col("output"), F.col("form"))
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
