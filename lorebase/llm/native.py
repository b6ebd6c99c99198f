"""Column helpers for operators that stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaps_of(text: Column, pattern: str) -> Column:
    """The texts between matches; always one more than there are matches."""
    return F.split(text, pattern, -1)


def matches_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Elements that are gathered together; appending to one long list would copy it every time.
CHUNK = 512


def gathered(steps: Column, zero: Column, step, kind: str) -> Column:
    """A fold that gives out a list: step(state, x) -> (new state, element of type kind).

    Each element joins the list one step later: `let` copies what it gives out, so it must not give out the list. Nor
    may a condition give out the long list, for it would be cast, element by element.
    """
    none, nothing = F.array().cast(f"array<array<{kind}>>"), F.array().cast(f"array<{kind}>")

    def add(s: Column, x: Column) -> Column:
        full = F.size(s["part"]) >= CHUNK
        state, element = step(s["now"]["state"], x)
        now = let(F.struct(state.alias("state"), element.alias("element")), lambda e: e)
        part = F.concat(F.when(full, nothing).otherwise(s["part"]), F.array(s["now"]["element"]))
        return F.struct(now.alias("now"), part.alias("part"), F.concat(s["out"], F.when(full, F.array(s["part"])).otherwise(none)).alias("out"))

    first = F.struct(F.struct(zero.alias("state"), F.lit(None).cast(kind).alias("element")).alias("now"), nothing.alias("part"), none.alias("out"))
    # before the first element stands the one of `first`
    return F.aggregate(steps, first, add, lambda s: let(F.flatten(F.concat(s["out"], F.array(s["part"], F.array(s["now"]["element"])))), lambda all_: F.slice(all_, F.lit(2), F.size(all_))))


def starts_of(gaps: Column, matches: Column) -> Column:
    """Start of each match in code points, from the lengths of what precedes it."""
    step = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    return gathered(step, F.lit(0), lambda at, x: (at + x["g"] + x["m"], at + x["g"]), "int")


def let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]
