"""Document fingerprints by I-Match over randomised lexicon subsets.

A document keeps its distinct terms whose inverse document frequency lies in a band, ordered by their
64-bit term id.  Hashing all of them gives the classic fingerprint; hashing what falls into each of several
randomised subsets of the lexicon gives one hash a subset.  Subsets come in levels of falling density,
so that small edits change the dense subsets only and large edits leave some of the sparse ones.

The terms of every document meet the band's terms in one join, and come together again by document; only
term ids are shuffled for that, not texts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.llm.common import cut

LEVELS, SUBSETS = 3, 16
#: The band of inverse document frequencies, ln(documents / documents with the term).
LEAST_IDF, MOST_IDF = math.log(5), math.log(1000)


def terms(text: Column) -> Column:
    """Distinct ids of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """The band's terms: those of two documents at least whose inverse document frequency lies between the two bounds.

    Document frequencies are counted over all rows of ``docs`` (column ``text``).
    """
    frequency = cut(docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count())
    n_docs = docs.count()
    return frequency.where((F.col("count") >= max(2, n_docs * math.exp(-most_idf))) & (F.col("count") <= max(2, n_docs * math.exp(-least_idf)))).select("term")


def _bits(shift: int, mask: int, wanted: int):
    """The terms with these bits: a term id is a hash, so its bits are as good as drawn."""
    return lambda t: F.shiftright(t, shift).bitwiseAND(mask) == wanted


def hashes(band: str, every: str) -> Column:
    """Hashes of a sorted array of band terms: ``first`` of all of them, then ``rest``, 32 bits of each subset's; null where one is empty.

    A text without a term of the band is ``bare`` and has the hash ``every`` of all its terms in place of the first.
    """
    levels = [F.col(band)]
    for k in range(1, LEVELS):
        levels.append(F.filter(levels[-1], _bits(2 * k, 3, 0)))
    subsets = F.array(*(F.filter(levels[k], _bits(16 + 8 * k, SUBSETS - 1, j)) for k in range(LEVELS) for j in range(SUBSETS)))
    rest = F.transform(subsets, lambda xs: F.when(F.size(xs) > 0, F.shiftright(F.xxhash64(xs), 32).cast("int")))
    bare = F.size(band) == 0
    return F.struct(bare.alias("bare"), F.when(bare, F.col(every)).otherwise(F.xxhash64(band)).alias("first"), rest.alias("rest"))


def written_out(marks: str) -> Column:
    """``hashes`` as texts: hexadecimal, with "=" before the first of a bare text and "-" where a subset is empty."""
    first = F.concat(F.when(F.col(f"{marks}.bare"), "=").otherwise(""), F.lpad(F.hex(f"{marks}.first"), 16, "0"))
    low = F.lit(0xFFFFFFFF).cast("long")
    return F.concat(F.array(first), F.transform(f"{marks}.rest", lambda x: F.coalesce(F.lpad(F.hex(x.cast("long").bitwiseAND(low)), 8, "0"), F.lit("-"))))


def likeness(a: str, b: str) -> Column:
    """Equal hashes as a share of those that either document has; 1 for equal fingerprints."""
    pairs = F.arrays_zip(F.col(f"{a}.rest").alias("a"), F.col(f"{b}.rest").alias("b"))
    head = (F.col(f"{a}.bare") == F.col(f"{b}.bare")) & (F.col(f"{a}.first") == F.col(f"{b}.first"))
    same = head.cast("int") + F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    either = 1 + F.size(F.filter(pairs, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(same / either)


def marked(rows: DataFrame, keys: list[str], texts: dict[str, str], band: DataFrame, extra: dict[str, Column], broadcast_terms: int = 1 << 18) -> DataFrame:
    """One row for each row of ``rows``, which ``keys`` tell apart: the keys, ``extra``, and for each (name, text column) of ``texts`` its hashes.

    The band is broadcast while its counted terms are ``broadcast_terms`` at most; beyond, the join shuffles.
    """
    small = F.broadcast if band.count() <= broadcast_terms else (lambda df: df)
    found = {n: terms(F.col(c)) for n, c in texts.items()}
    head = F.struct(*(c.alias(n) for n, c in extra.items()), *(F.xxhash64(F.sort_array(x)).alias(f"{n}_every") for n, x in found.items()))
    rows = rows.select(*keys, head.alias("head"), *(x.alias(n) for n, x in found.items()))
    kind = "struct<kind:int,term:bigint>"
    numbered = lambda k: lambda t: F.struct(F.lit(k).alias("kind"), t.alias("term"))
    one = F.concat(F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("term")).cast(kind)), *(F.transform(n, numbered(k)) for k, n in enumerate(found)))
    # a row's head stands beside the first of its terms alone
    spread = rows.select(*keys, "head", F.posexplode(one).alias("at", "t")).select(*keys, F.when(F.col("at") == 0, F.col("head")).alias("head"), "t.kind", "t.term")
    held = spread.join(small(band.withColumn("known", F.lit(True))), "term", "left").where(F.col("known") | (F.col("kind") < 0))
    bands = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("term")))).alias(n) for k, n in enumerate(found)]
    whole = held.groupBy(*keys).agg(F.first("head", ignorenulls=True).alias("head"), *bands).select(*keys, "head.*", *found)
    return whole.select(*keys, *extra, *(hashes(n, f"{n}_every").alias(n) for n in found))


def with_next(df: DataFrame, column: str, rows_a_range: int = 64, most_ranges: int = 1 << 16) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows by descending ``doc_id`` (after the last the first), and the places ``range``, ``nth``, ``next_range``, ``next_nth``.

    Null ids come last; equal ids are ordered by the text's hash, and rows that agree in both follow each
    other in any order (and share a range, having one key).  Rows are dealt by ranges of this order, cut at sampled rows, so that neither
    distant ids nor repeated ones make a range long; the first row of each range is copied to the end of
    the range before it, so no range needs another.  With n rows there are about n / ``rows_a_range``
    ranges, ``most_ranges`` at most.
    """
    df = df.withColumn("_key", F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("tie")))
    n = df.count()
    side = max(1, math.isqrt(min(most_ranges, n // rows_a_range)))
    # 16 sampled keys a range at about the most: small rows of three values
    sample = sorted(tuple(r["_key"]) for r in df.select("_key").sample(min(1.0, 16 * side * side / max(n, 1)), 7).collect())
    cuts = [dict(zip(("some", "id", "tie"), sample[len(sample) * k // (side * side)], strict=True)) for k in range(1, side * side)] if sample else []
    kind = df.select("_key").schema[0].dataType.simpleString()
    literal = lambda keys, kind: F.from_json(F.lit(json.dumps(keys)), kind)
    passed = lambda keys: F.size(F.filter(keys, lambda c: c <= F.col("_key")))
    df = df.withColumn("_coarse", passed(literal(cuts[side - 1 :: side], f"array<{kind}>")))
    fine = literal([cuts[k * side : (k + 1) * side - 1] for k in range(side)], f"array<array<{kind}>>")
    df = df.withColumn("_home", (F.col("_coarse") * side + passed(F.get(fine, F.col("_coarse")))).cast("long")).drop("_coarse")
    heads = cut(df.groupBy("_home").agg(F.max("_key").alias("_head")))
    order = Window.orderBy(F.desc("_home"))  # as many rows as ranges
    heads = heads.withColumn("_before", F.coalesce(F.lag("_home").over(order), F.min("_home").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    place = lambda r, copy: F.struct(r.alias("range"), F.lit(copy).alias("_copy"))
    here = place(F.col("_home"), 0)
    dealt = df.join(F.broadcast(heads), "_home").withColumn("_place", F.explode(F.when(F.col("_key") == F.col("_head"), F.array(here, place(F.col("_before"), 1))).otherwise(F.array(here))))
    dealt = dealt.select(*df.columns, "_place.range", "_place._copy")
    # partitioned by range: what groups by range and nth later needs no shuffle of its own
    window = Window.partitionBy("range").orderBy("_copy", F.desc("_key"))
    following = F.lead(F.struct(F.col(column).alias("c"), F.col("_home").alias("r"), F.col("_copy").alias("copy"))).over(window)
    dealt = dealt.withColumns({"nth": F.row_number().over(window), "_next": following}).where(F.col("_copy") == 0)
    return dealt.withColumns({
        f"next_{column}": F.col("_next.c"), "next_range": F.col("_next.r"), "next_nth": F.when(F.col("_next.copy") == 1, 1).otherwise(F.col("nth") + 1),
    }).drop("_key", "_home", "_copy", "_next")


def fingerprint_documents(docs: DataFrame, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """Adds ``marks``, the array of hashes, to ``docs``; document frequencies are counted over all its rows.

    A null text counts as empty.  A text without a term in the band has the hash of all its terms and
    otherwise "-" marks, so it is like none but those of the same terms.  Equal texts have equal marks.
    Extra columns stay; one named ``marks`` is replaced.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("whole")))
    made = marked(rows.select("row", "text"), ["row"], {"marks": "text"}, lexicon(rows, least_idf, most_idf), {})
    return rows.select("row", "whole").join(made, "row").select(*(F.col(f"whole.`{c}`") for c in docs.columns if c != "marks"), written_out("marks").alias("marks"))


def edited_report(docs: DataFrame, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    band = lexicon(docs, least_idf, most_idf)
    rows = with_next(docs, "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half)))
    extra = {"doc_id": F.col("doc_id"), "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited_text").cast("binary"), 256), "next_range": F.col("next_range"), "next_nth": F.col("next_nth")}
    made = cut(marked(rows, ["range", "nth"], {"marks": "text", "edited": "edited_text"}, band, extra))
    after = made.select(F.col("range").alias("next_range"), F.col("nth").alias("next_nth"), F.col("marks").alias("next_marks"))
    return made.join(after, ["next_range", "next_nth"]).select(
        "doc_id", "n_chars", "edited_sha256", F.array_join(written_out("marks"), ":").alias("fingerprint"), F.array_join(written_out("edited"), ":").alias("edited_fingerprint"),
        likeness("marks", "edited").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"),
    )
