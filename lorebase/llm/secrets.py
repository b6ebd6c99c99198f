"""Operator 2: secret scans inside Spark expressions.

Base findings, leftmost and non-overlapping for each kind: assignments to a secret-like name with a value of 6
or more characters, access keys of 20 or more, hex runs of 24 or more. The method adds candidate strings whose
Shannon entropy in some window of 20 characters reaches the threshold of their character class. The entropy is
kept incrementally: a character that enters or leaves the window changes one count c, of those packed into six longs,
and hence the sum of c * log2(c), held in integers of 1e-9 bit so that results don't depend on the order of additions.
Candidates that match the allow-list, lack a digit or a letter, or lie inside a base finding are suppressed. A candidate starts
behind leading =, which no key has; leading - and _ stay, but don't change its class.

A null or empty text has no findings: counts 0 and the digest of the empty string. Rows are kept one to one, those
of null doc_id too, so ties and repeated rows need no rule; an empty table gives no rows. Of extra columns only
base_spans and all_spans are replaced. The work is linear in the text, however long its runs are, but for the list of
its findings, which is copied as it grows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import gaps_of, let, matches_of, starts_of

ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
#: The same findings as runs [0-9a-f]+ of which those under 24 are dropped: a run is maximal either way.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits for each character class of a candidate; a window of 20 has at most 4 (hex) or 4.32 bits.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_alnum": 3.9, "entropy_base64": 3.9}
#: Candidates in which one of these is found are no secrets: UUIDs, documentation keys, counting runs. Nor are PATHs.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:example|sample|placeholder|dummy|changeme|lorem)",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
)
_WORD = r"(?:[A-Z]++(?![a-z])|[A-Z]?[a-z]*+)[0-9]*+"
_PART = rf"{_WORD}(?:[-_]{_WORD})*+"
#: Absolute paths and URLs without their scheme, of plain words (letters, then digits) only.
PATH = rf"^(?=/|.*//){_PART}(?:/{_PART})*+$"
UNIT = 10**9


def _c_log_c() -> list[int]:
    return [round(UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]


def _most_sum(bits: float) -> int:
    """A window has at least so many bits when its sum of c * log2(c) is at most this."""
    return round(UNIT * WINDOW * (math.log2(WINDOW) - bits))


#: The characters of candidates; five bits of a long count one of them, twelve fit.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
EACH, BITS = 12, 5


def _least_sum(candidate: Column) -> Column:
    """The least sum of c * log2(c) over the candidate's windows."""
    f = F.array(*[F.lit(x).cast("long") for x in _c_log_c()])
    unit = F.array(*[F.lit(1 << BITS * i).cast("long") for i in range(EACH)])
    longs = -(-len(ALPHABET) // EACH)

    def count(counts: Column, x: Column) -> Column:
        return F.pmod(F.call_function("div", counts[x["long"]], unit[x["at"]]), F.lit(1 << BITS)).cast("int")

    def changed(counts: Column, x: Column, by: int) -> Column:
        return F.transform(counts, lambda v, i: F.when(i == x["long"], v + by * unit[x["at"]]).otherwise(v))

    def step(s: Column, x: Column) -> Column:
        def enter(n: Column) -> Column:
            return F.struct(changed(s["counts"], x["new"], 1).alias("counts"), (s["sum"] + f[n + 1] - f[n]).alias("sum"))

        def leave(e: Column) -> Column:
            return let(count(e["counts"], x["old"]), lambda n: F.struct(changed(e["counts"], x["old"], -1).alias("counts"), (e["sum"] + f[n - 1] - f[n]).alias("sum")))

        moved = let(let(count(s["counts"], x["new"]), enter), lambda e: F.when(x["old"].isNotNull(), leave(e)).otherwise(e))
        return let(moved, lambda m: F.struct(m["counts"].alias("counts"), m["sum"].alias("sum"), F.when(x["full"], F.least(s["best"], m["sum"])).otherwise(s["best"]).alias("best")))

    code = lambda c: let(F.instr(F.lit(ALPHABET), c) - 1, lambda k: F.struct(F.floor(k / EACH).cast("int").alias("long"), F.pmod(k, F.lit(EACH)).alias("at")))
    codes = F.transform(F.split(candidate, ""), code)
    steps = let(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, cs[i - WINDOW]).alias("old"), (i >= WINDOW - 1).alias("full"))))
    zero = F.struct(F.array(*[F.lit(0).cast("long")] * longs).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(2**62).cast("long").alias("best"))
    return F.aggregate(steps, zero, step)["best"]


def _spans(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """array<struct<start, rank, end, kind, value>> of one kind."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    rank = KINDS.index(kind)
    found = F.arrays_zip(starts_of(gaps_of(text, pattern), matches_of(text, pattern)).alias("s"), matches_of(text, pattern).alias("m"), matches_of(text, pattern, group).alias("v"))
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["v"]))
    rows = F.transform(found, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), (x["s"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
    return F.when(F.regexp(text, F.lit(pattern)), rows).otherwise(none)


def _entropy_spans(text: Column) -> Column:
    """Candidates with class and windowed entropy over the threshold."""
    bare = F.transform(_spans(text, CANDIDATE, "entropy_base64"), lambda x: x.withField("value", F.regexp_replace(x["value"], "^=+", "")))
    bare = F.transform(bare, lambda x: x.withField("start", x["end"] - F.length(x["value"])))
    found = F.filter(
        bare,
        lambda x: (F.length(x["value"]) >= WINDOW)
        & F.regexp(x["value"], F.lit("[0-9]"))
        & F.regexp(x["value"], F.lit("[A-Za-z]"))
        & ~F.regexp(x["value"], F.lit("|".join(f"(?:{a})" for a in (*ALLOW, PATH)))),
    )
    named = F.transform(
        found,
        lambda x: x.withField(
            "kind", F.when(F.regexp(x["value"], F.lit("^[-_]*(?:[0-9a-f]+|[0-9A-F]+)$")), "entropy_hex").when(F.regexp(x["value"], F.lit("^[-_]*[A-Za-z0-9]+$")), "entropy_alnum").otherwise("entropy_base64")
        ),
    )
    ranked = F.transform(named, lambda x: x.withField("rank", F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int") - 1))
    limit = lambda k: F.when(k == "entropy_hex", _most_sum(THRESHOLDS["entropy_hex"])).otherwise(_most_sum(THRESHOLDS["entropy_base64"]))
    return F.filter(ranked, lambda x: _least_sum(x["value"]) <= limit(x["kind"]))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns base_spans and all_spans: array<struct<start, rank, end, kind, value>>; replaces columns so named."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        _spans(text, ASSIGN, "assign", lambda v: F.length(v) >= 6, group=2),
        _spans(text, ACCESS, "access", lambda v: F.length(v) >= 20),
        _spans(text, HEX, "hex"),
    )
    out = docs.withColumn("base_spans", base).withColumn("all_spans", _entropy_spans(text))
    apart = F.filter("all_spans", lambda x: ~F.exists(F.col("base_spans"), lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return out.withColumn("all_spans", F.concat("base_spans", apart))


def secret_digests(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
        _written(F.col("all_spans")).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    def spans(kind: str, pattern: str, keep: str, value: str = "m[i]") -> str:
        p = pattern.replace("'", "''")
        return (
            f"list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'r': {KINDS.index(kind)}, "
            f"'m': m[i], 'v': {value.format(p=p)}, 'kind': '{kind}'}}), lambda x: {keep}) FROM (SELECT regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g)"
        )

    allow = "|".join(f"(?:{a})" for a in ALLOW).replace("'", "''")
    word = "([A-Z]+|[A-Z]?[a-z]*)[0-9]*"
    table = "[" + ", ".join(map(str, _c_log_c())) + "]"
    hexes, rest = _most_sum(THRESHOLDS["entropy_hex"]), _most_sum(THRESHOLDS["entropy_base64"])
    window = f"list_sum(list_transform(list_distinct(string_split(substr(v, i, {WINDOW}), '')), lambda c: ({table})[1 + length(substr(v, i, {WINDOW})) - length(replace(substr(v, i, {WINDOW}), c, ''))]))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_concat(
  (SELECT {spans("assign", ASSIGN, "length(x.v) >= 6", "regexp_extract(m[i], '{p}', 2)")}),
  (SELECT {spans("access", ACCESS, "length(x.v) >= 20")}),
  (SELECT {spans("hex", "[0-9a-f]+", "length(x.v) >= 24")})) AS base FROM d),
r AS (SELECT doc_id, unnest((SELECT {spans("entropy_base64", CANDIDATE, "true")})) AS x, base FROM b),
c AS (SELECT doc_id, base, x.s + length(x.m) AS e, regexp_replace(x.m, '^=+', '') AS v FROM r),
k AS (SELECT doc_id, e - length(v) AS s, e, v,
  CASE WHEN regexp_matches(v, '^[-_]*([0-9a-f]+|[0-9A-F]+)$') THEN 'entropy_hex' WHEN regexp_matches(v, '^[-_]*[A-Za-z0-9]+$') THEN 'entropy_alnum' ELSE 'entropy_base64' END AS kind
  FROM c WHERE length(v) >= {WINDOW} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{allow}')
  AND NOT ((v LIKE '/%' OR contains(v, '//')) AND regexp_full_match(v, '{word}([-_/]{word})*'))
  AND len(list_filter(base, lambda q: q.s <= e - length(v) AND e <= q.s + length(q.m))) = 0),
h AS (SELECT doc_id, list({{'s': s, 'r': list_position({list(KINDS)}, kind) - 1, 'e': e, 'kind': kind}}) AS more FROM k
  WHERE list_min(list_transform(range(1, length(v) - {WINDOW - 2}), lambda i: {window})) <= CASE WHEN kind = 'entropy_hex' THEN {hexes} ELSE {rest} END GROUP BY doc_id),
f AS (SELECT b.doc_id, list_transform(base, lambda x: {{'s': x.s, 'r': x.r, 'e': x.s + length(x.m), 'kind': x.kind}}) AS base, more FROM b LEFT JOIN h ON h.doc_id = b.doc_id)
SELECT doc_id, CAST(len(list_filter(base, lambda x: x.kind = 'assign')) AS BIGINT) AS n_assign, CAST(len(list_filter(base, lambda x: x.kind = 'access')) AS BIGINT) AS n_access,
  CAST(len(list_filter(base, lambda x: x.kind = 'hex')) AS BIGINT) AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_sort(base), lambda x: concat(x.kind, ':', x.s, ':', x.e)), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(list_sort(list_concat(base, more)), lambda x: concat(x.kind, ':', x.s, ':', x.e)), ','), '') AS spans FROM f
"""


ORACLE = _oracle()
