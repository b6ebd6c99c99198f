"""Operator 4: format-preserving pseudonyms of personal data, inside Spark expressions.

Finds e-mail addresses, phone numbers, payment cards (Luhn), IPv4 addresses, social security numbers and
calendar dates; what fails its validation is left as it is. Numbers and dates are replaced by a keyed
permutation of the values of their own format, so that equal values become equal pseudonyms in every document,
different values stay different, and separators, length and validity are kept:

    card   all digits but the last are permuted, the last is the new Luhn digit
    phone  the country code stays, the rest is permuted among numbers of that many digits
    ipv4   permuted among all addresses
    ssn    permuted among valid area, group and serial numbers
    date   permuted among the 146,097 days of 1800-01-01 to 2199-12-31

The permutation is a Feistel network over Z_a x Z_b with modular addition, a * b being the size of the format,
so no value needs a second walk. Its round function is SHA-256 of key, kind, round and half. An e-mail address
has no fixed format: its local part and host become a keyed digest under a reserved domain.

Digits in groups, with single spaces or dashes between, are read as one run, which ends where another kind starts. Any
neighbouring groups of a run with 13 to 19 digits together may be a card. From left to right, valid ones of a usual
layout are taken first (one group, 4-4-4-4, 4-6-5, 4-6-4, 4-4-4-4-3), then the longest valid ones of any layout that
overlap none of them.

A null text stays null, an empty one empty; an empty table gives no rows. Rows are kept one to one, with null doc_ids,
repeated rows and extra columns, of which only pii is replaced. Patterns are possessive, so long texts cost no stack, and
work is linear in the text but for lists of findings, which are copied as they grow: a text of 10^5 findings, or a
run of 10^5 groups of digits, takes about a minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import gaps_of, gathered, let, matches_of

KINDS = ("email", "phone", "card", "ipv4", "ssn", "date")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])(?:1[89]|2[01])[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
}
#: No other kind starts here.
_APART = f"(?!{'|'.join(PATTERNS[k] for k in ('email', 'ipv4', 'ssn', 'date'))})"
#: Maximal runs of groups of digits, of which the first ones have 13 to 19 digits together. The possessive repeats keep
#: the matcher from recursing over long runs.
RUN = rf"(?<![0-9A-Za-z]){_APART}(?=[0-9](?:(?:[ -]{_APART})?[0-9]){{12,18}}(?![0-9A-Za-z]))[0-9]++(?:[ -]{_APART}[0-9]++(?![0-9A-Za-z]))*+"
#: What only a run looks like, whatever stood beside it.
IS_RUN = "^[0-9](?:[ -]?[0-9]){12}[0-9 -]*+$"
ANY = "|".join([PATTERNS["email"], PATTERNS["phone"], RUN, PATTERNS["ipv4"], PATTERNS["ssn"], PATTERNS["date"]])
CARD_MIN, CARD_MAX = 13, 19
LAYOUTS = ("4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3")
PART = "struct<kind:string,value:string>"
ROUNDS = 8


def _round(key: str, kind: str, number: Column, half: Column, modulus: Column | int) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), number.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), F.lit(modulus) if isinstance(modulus, int) else modulus)


def feistel(value: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1 (as longs)."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _round(key, kind, i, s["r"], a), a)
        return let(left, lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + _round(key, kind, i + 1, x, b), b).alias("r")))

    return let(
        F.aggregate(F.array(*[F.lit(i) for i in range(0, ROUNDS, 2)]), F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r")), step),
        lambda s: s["l"] * b + s["r"],
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _digit_list(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: c.cast("int"))


def _luhn_sum(digits: Column, skip: int) -> Column:
    """Sum with every second digit doubled, counted from the right; skip=1 starts with a doubled one."""
    doubled = F.transform(F.reverse(_digit_list(digits)), lambda d, i: F.when((i + skip) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits permuted among all of their number (18 at most)."""
    n = F.length(digits)
    power = lambda k: F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(10)]), k + 1)
    high = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), power(high), power(n - high), key, kind).cast("string"), n, F.lit("0"))


def _into(template: Column, digits: Column) -> Column:
    """template with its digits replaced, in order."""
    zero = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
    return F.aggregate(
        F.split(template, ""),
        zero,
        lambda s, c: F.when(c.between("0", "9"), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(digits, s["i"] + 1, F.lit(1))).alias("out"))).otherwise(
            F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))
        ),
    )["out"]


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    made = let(_permuted_digits(body, key, "card"), lambda d: F.concat(d, F.pmod(10 - _luhn_sum(d, 1) % 10, F.lit(10)).cast("string")))
    return let(made, lambda d: _into(m, d))


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    code = F.substring(digits, F.lit(1), F.length(digits) - 10)
    return let(F.concat(code, _permuted_digits(F.right(digits, F.lit(10)), key, "phone")), lambda d: _into(m, d))


def _ipv4(m: Column, key: str) -> Column:
    number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    octet = lambda v, i: F.pmod(F.shiftright(v, 8 * i), F.lit(256)).cast("string")
    return let(feistel(number, 65536, 65536, key, "ipv4"), lambda v: F.concat_ws(".", octet(v, 3), octet(v, 2), octet(v, 1), octet(v, 0)))


#: Valid areas are 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
SSN_A, SSN_B = 898 * 99, 9999


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    rank = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * SSN_B + serial - 1

    def written(v: Column) -> Column:
        a = F.floor(v / (99 * SSN_B)) + 1
        a = a + (a >= 666).cast("long")
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(v / SSN_B), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(v, F.lit(SSN_B)) + 1).cast("string"), 4, "0"))

    return let(feistel(rank, SSN_A, SSN_B, key, "ssn"), written)


#: The days of the 400 years from 1800-01-01: 146,097 = 189 * 773.
FIRST_DAY, DATE_A, DATE_B = "1800-01-01", 189, 773


def _date(m: Column, key: str) -> Column:
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(day, DATE_A, DATE_B, key, "date").cast("int")).cast("string")


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.example"))


def _groupings(groups: Column) -> Column:
    """For each group: the numbers of groups from it on that form a card, and that of a usual layout (0 for none)."""

    def valid(part: Column) -> Column:
        return let(F.array_join(part, ""), lambda d: F.length(d).between(CARD_MIN, CARD_MAX) & (_luhn_sum(d, 0) % 10 == 0) & F.regexp(d, F.lit("[1-9]")))

    def usual(part: Column) -> Column:
        return (F.size(part) == 1) | F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), "-").isin(*LAYOUTS)

    def of(i: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(CARD_MAX), F.size(groups) - i + 1))
        ns = F.filter(sizes, lambda n: valid(F.slice(groups, i, n)))
        return let(ns, lambda v: F.struct(v.alias("ns"), F.coalesce(F.array_max(F.filter(v, lambda n: usual(F.slice(groups, i, n)))), F.lit(0)).alias("usual")))

    return F.transform(F.sequence(F.lit(1), F.size(groups)), of)


def _run_parts(run: Column) -> Column:
    """array<struct<kind, value>>: cards of a run, and what is between them with a null kind."""

    def chosen(groups: Column, found: Column) -> Column:
        """For each group: of how many groups the card is that begins there, 0 for none, -1 inside a card."""

        def step(free: Column, i: Column) -> tuple[Column, Column]:
            here = F.element_at(found, i)
            other = F.array_max(F.filter(here["ns"], lambda n: ~F.exists(F.slice(found, i + 1, n - 1), lambda x: x["usual"] > 0)))
            n = F.when(i < free, -1).when(here["usual"] > 0, here["usual"]).otherwise(F.coalesce(other, F.lit(0)))
            return F.when(n > 0, i + n).otherwise(free), n

        return gathered(F.sequence(F.lit(1), F.size(groups)), F.lit(1), step, "int")

    def pieces(groups: Column, behind: Column, ns: Column) -> Column:
        """groups: with behind, the separator after each, they make the run."""
        part = lambda kind, value: F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"))

        def of(n: Column, i: Column) -> Column:
            last = i + n - 1
            card = F.concat(F.array_join(F.zip_with(F.slice(groups, i + 1, n - 1), F.slice(behind, i + 1, n - 1), lambda g, b: F.concat(g, b)), ""), groups[last])
            return F.when(n > 0, F.array(part("card", card), part(None, behind[last]))).when(n == 0, F.array(part(None, F.concat(groups[i], behind[i])))).otherwise(F.array().cast(f"array<{PART}>"))

        return F.flatten(F.transform(ns, of))

    behind = F.concat(F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    return let(F.split(run, "[ -]"), lambda g: let(behind, lambda b: let(let(_groupings(g), lambda found: chosen(g, found)), lambda ns: pieces(g, b, ns))))


def _parts(m: Column) -> Column:
    """array<struct<kind, value>> of a match of ANY."""
    whole = F.array(F.struct(_kind(m).alias("kind"), m.alias("value"))).cast(f"array<{PART}>")
    return F.when(F.regexp(m, F.lit(IS_RUN)), _run_parts(m).cast(f"array<{PART}>")).otherwise(whole)


def _kind(m: Column) -> Column:
    """The kind that a match of ANY other than a run passes validation as, or null."""
    is_ = lambda k: F.regexp(m, F.lit(f"^(?:{PATTERNS[k]})$"))
    octets = F.forall(F.split(m, r"\."), lambda x: F.length(x).between(1, 3) & (x.cast("int") < 256))
    ssn = ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(F.startswith(m, F.lit("+")), "phone")
        .when(is_("ipv4"), F.when(octets, "ipv4"))
        .when(is_("ssn"), F.when(ssn, "ssn"))
        .when(is_("date"), F.when(F.try_to_date(m, "yyyy-MM-dd").isNotNull(), "date"))
    )


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    return F.when(kind == "email", _email(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "card", _card(m, key)).when(kind == "ipv4", _ipv4(m, key)).when(kind == "ssn", _ssn(m, key)).when(kind == "date", _date(m, key)).otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text replaced and pii: array<struct<kind, value, pseudonym>> in order; a column so named is replaced."""
    text = F.col(text_col)
    read = lambda m: F.transform(_parts(m), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["kind"], x["value"], key).alias("pseudonym")))
    held = F.regexp(text, F.lit("[0-9@]"))
    none = F.array().cast("array<array<struct<kind:string,value:string,pseudonym:string>>>")
    out = docs.withColumn("pii", F.when(held, F.transform(matches_of(text, ANY), read)).otherwise(none))
    after = F.concat(F.transform("pii", lambda m: F.array_join(F.transform(m, lambda x: x["pseudonym"]), "")), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(gaps_of(text, ANY), after, lambda g, p: F.concat(g, p)), "")
    return out.withColumn(text_col, F.when(F.size("pii") > 0, rebuilt).otherwise(text)).withColumn("pii", F.filter(F.flatten("pii"), lambda x: x["kind"].isNotNull()))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text, findings by kind, and kind=pseudonym pairs in order."""
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key="op4")
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", *counts, F.array_join(F.transform("pii", lambda x: F.concat_ws("=", x["kind"], x["pseudonym"])), ",").alias("pseudonyms"))
