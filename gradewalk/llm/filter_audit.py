"""Filter interaction audit: what each of several filters removes, in every order of them.

A row's failures are a mask, one bit a filter.  The rows that a set of filters removes, as a function of
the set, extend to a polynomial on the cube: f(x) = sum of n(mask) * (1 - product of (1 - x_i) over the mask),
with one coefficient a set of filters.  Its value at a corner is what the filters of that corner remove;
the integral of its i-th partial derivative along the diagonal is filter i's Shapley value.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_FILTERS = 6  # orders are listed, so their number is that of the factorial


def text_filters(text: str, words: str) -> dict[str, Column]:
    """Failures A to D of a text, given its words as an array: short, repetitive, shouting, with symbols."""
    t, n, distinct = F.col(text), F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(t) - F.length(F.translate(t, CAPITALS, ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(t), "D": t.rlike(r"[#$%&*|]")}


def removal_polynomial(mask: str, count: str, n_filters: int) -> Column:
    """Aggregate: the polynomial's terms (set of filters, coefficient) from the counts of masks.

    1 - product of (1 - x_i) has the coefficient 1 for odd subsets of the mask and -1 for even ones.
    """
    inside = lambda term: F.sum(F.when(F.col(mask).bitwiseAND(term) == term, F.col(count)).otherwise(0))
    return F.array(*(F.struct(F.lit(t).alias("term"), (inside(t) * (1 if t.bit_count() % 2 else -1)).alias("coef")) for t in range(1, 1 << n_filters)))


def at_corner(polynomial: Column, corner: Column | int) -> Column:
    """The polynomial where the filters of ``corner`` are 1 and the others 0: the terms inside it."""
    within = F.filter(polynomial, lambda t: t["term"].bitwiseAND(corner) == t["term"])
    return F.aggregate(within, F.lit(0).cast("long"), lambda a, t: a + t["coef"])


def corner_values(polynomial: Column, n_filters: int) -> Column:
    """Its values at all corners, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)), lambda s: at_corner(polynomial, s))


def along_diagonal(polynomial: Column, i: int, n_filters: int, scale: int) -> Column:
    """``scale`` times the integral of the i-th partial derivative at (t, ..., t) for t from 0 to 1.

    A term of k filters derives to t ** (k - 1), whose integral is 1/k.  The rationals are summed over
    their common denominator, so nothing is rounded; ``scale`` must be a multiple of it.
    """
    integrals = [Fraction(1, k) for k in range(1, n_filters + 1)]
    common = math.lcm(*(f.denominator for f in integrals))
    numerators = F.array(*(F.lit(int(f * common)).cast("long") for f in integrals))
    touched = F.filter(polynomial, lambda t: t["term"].bitwiseAND(1 << i) != 0)
    over_common = F.aggregate(touched, F.lit(0).cast("long"), lambda a, t: a + t["coef"] * F.element_at(numerators, F.bit_count(t["term"])))
    return over_common * int(Fraction(scale, common))


def with_repeats(rows: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """Adds ``name``: whether a row with a smaller ``key`` has the same ``digest``; false for null keys.

    First keys come from a grouping with partial minima; rows meet them by key and digest, so that a
    digest with a third of the rows isn't a key of any join.
    """
    firsts = rows.groupBy(digest).agg(F.min(key).alias(key)).withColumn("_first", F.lit(True))
    return rows.join(firsts, [key, digest], "left").withColumn(name, F.col("_first").isNull() & F.col(key).isNotNull()).drop("_first")


def audit(rows: DataFrame, filters: dict[str, str], part: str, lost: dict[str, str]) -> DataFrame:
    """One row per value of ``part``, order of the filters and step.

    ``filters``: letters and boolean columns that are true where a row fails (null: false).  ``lost``:
    names and boolean columns of rows whose loss is counted (null: false).  Columns: part, filter_order, step,
    kept, removed, redundant (failing, removed earlier), unique_fails (failing nothing else), one of each of
    ``lost``, and shapley (what the filter removes, summed over all orders).  Steps that remove nothing are
    there too.  Null parts are one part.  An empty table has no rows.  Repeated rows count each.

    Rows shuffle as counts of (part, mask), 2 ** filters a part and task at most, so a part with a third of
    all rows costs no more than another.
    """
    letters, m = list(filters), len(filters)
    if not 1 <= m <= MOST_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"one to {MOST_FILTERS} filters, named by one letter each")
    mask = sum((F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    masked = rows.select(F.col(part).alias("part"), mask.alias("mask"), *(F.col(c).alias(f"lost_{i}") for i, c in enumerate(lost.values())))
    counted = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.count_if(f"lost_{i}").alias(f"n_{i}") for i in range(len(lost))))
    names = {"n": "all", **{f"n_{i}": f"p_{i}" for i in range(len(lost))}}
    parts = counted.groupBy("part").agg(F.sum("n").alias("total"), *(removal_polynomial("mask", n, m).alias(p) for n, p in names.items()))
    parts = parts.select(
        "part", "total", F.array(*(along_diagonal(F.col("all"), i, m, math.factorial(m)) for i in range(m))).alias("shares"),
        *(corner_values(F.col(p), m).alias(f"f_{p}") for p in names.values()))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(letters)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(m))))
    applied = lambda till: sum((F.when(F.instr("filter_order", x) <= till, 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"before": applied(F.col("step") - 1), "after": applied(F.col("step"))})
    own, f = F.col("after") - F.col("before"), lambda p, s: F.get(F.col(f"f_{p}"), s)
    removed = f("all", F.col("after")) - f("all", F.col("before"))
    full = F.lit((1 << m) - 1)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - f("all", F.col("after"))).alias("kept"), removed.alias("removed"), (f("all", own) - removed).alias("redundant"),
        (f("all", full) - f("all", full - own)).alias("unique_fails"),
        *((f(f"p_{i}", F.col("after")) - f(f"p_{i}", F.col("before"))).alias(name) for i, name in enumerate(lost)),
        F.get("shares", F.instr(F.lit("".join(letters)), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five text filters by language.

    A: under 200 words.  B: under half of the words distinct.  C: over 3 per cent capitals.  D: holds one of
    ``#$%&*|``.  E: a smaller doc_id has the same text (known by SHA-256).  Words are maximal runs without
    ASCII space; a null text is empty, a null language the empty string.  A null doc_id fails no E and has no
    label.  Of several labels of a document any that says 1 counts.  Other columns, clashing ones too, are ignored.

    Texts are read once: flags and digest are written to the shared folder, everything else works on these.
    """
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    flags = cut(text.select("doc_id", "part", *(c.alias(x) for x, c in text_filters("text", "words").items()), F.sha2("text", 256).alias("digest")))
    judged = with_repeats(flags, "doc_id", "digest", "E").drop("digest")
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(judged.join(said, "doc_id", "left"), {x: x for x in "ABCDE"}, "part", {"good_lost": "good", "toxic_lost": "toxic"})
