"""Secret scans: a trigram inverted index proposes (document, rule) pairs, the rules' patterns verify them.

From each pattern the strings that every match must contain are derived, and from these a Boolean query:
an OR of clauses, each an AND of trigrams.  Postings (trigram, document) are kept for the trigrams that
some query names; a clause holds for a document when the postings of all its trigrams do.  A pattern
without mandatory trigrams is matched against every text.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import literal_table, row_key


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, then those that this scan adds.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
ADDED = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("hub", r"ghp_[A-Za-z0-9]{36,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
]


def _runs(tree, most: int = 64) -> list[list[str]]:
    """Alternatives of a pattern, each the literal runs that it contains in order; "" breaks a run."""
    found: list[list[str]] = [[""]]

    def then(more: list[list[str]]) -> None:
        nonlocal found
        joined = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in found for b in more]
        found = joined if len(joined) <= most else [[""]]

    for op, arg in tree:
        if op is C.LITERAL:
            then([[chr(arg)]])
        elif op is C.BRANCH:
            then([x for branch in arg[1] for x in _runs(branch, most)])
        elif op is C.SUBPATTERN:
            then(_runs(arg[-1], most))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            if (low, high) == (0, 1):
                then([[""], *_runs(inner, most)])
            elif low >= 1:
                then([[*x, ""] for x in _runs(inner, most)] if high != low or low > 1 else _runs(inner, most))
                if high > 1:
                    then([["", ""]])
            else:
                then([["", ""]])
        elif op is C.AT:
            continue
        else:
            then([["", ""]])
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that each match's text fulfils; empty: no mandatory trigrams."""
    clauses = []
    for runs in _runs(P.parse(pattern)):
        grams = {run[i : i + 3].lower() for run in runs for i in range(len(run) - 2)}
        if not grams:
            return []
        clauses.append(frozenset(grams))
    return [c for c in dict.fromkeys(clauses) if not any(d < c for d in clauses)]


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches that don't overlap, as (start, order, kind, end) in code points."""
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    held = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def span(n: Column, i: Column) -> Column:
        start = total(F.slice(pieces, 1, i + 1)) + total(F.slice(whole, 1, i))
        return F.struct(start.alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), (start + n).alias("end"), (F.get(held, i) >= rule.least).alias("good"))

    return F.filter(F.transform(whole, span), lambda x: x["good"])


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: one row (trigram, document key) where the lower-cased text has the trigram."""
    low = F.lower("text")
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return docs.withColumn("low", low).select(F.explode(held).alias("gram"), "key_id", "key_hash")


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns ``doc_id``, ``text``): doc_id, key columns and ``found``, an array of (start, place, kind, end).

    Null texts count as empty; rows with a null id are scanned too; rows that agree in id and text get
    the same spans each.  Texts are scanned whole.  Spans are ordered by start, then by the rule's place.
    """
    rules = [*BASE, *ADDED] if rules is None else rules
    spark = docs.sparkSession
    keyed = row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for c in q for g in c})
    clauses = [(g, place, n, 1 << i, (1 << len(c)) - 1) for place, q in enumerate(queries) for n, c in enumerate(q) for i, g in enumerate(sorted(c))]
    parts = []
    if clauses:
        wanted = literal_table(spark, clauses, ["gram", "place", "clause", "bit", "all"])
        candidates = (
            postings(keyed, grams).join(F.broadcast(wanted), "gram")
            .groupBy("key_id", "key_hash", "place", "clause").agg(F.bit_or("bit").alias("bits"), F.max("all").alias("all"))
            .where(F.col("bits") == F.col("all"))
            .groupBy("key_id", "key_hash").agg(F.collect_set("place").alias("places"))
        )
        verified = [F.when(F.array_contains("places", place), _spans(F.col("text"), r, place)).otherwise(F.array()) for place, r in enumerate(rules) if queries[place]]
        parts.append(keyed.join(candidates, ["key_id", "key_hash"]).select("key_id", "key_hash", F.explode(F.flatten(F.array(*verified))).alias("s")))
    for place, r in enumerate(rules):
        if not queries[place]:
            parts.append(keyed.where(F.col("text").rlike(r.pattern)).select("key_id", "key_hash", F.explode(_spans(F.col("text"), r, place)).alias("s")))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    spans = spans.groupBy("key_id", "key_hash").agg(F.sort_array(F.collect_set(F.struct("s.start", "s.place", "s.kind", "s.end"))).alias("found"))
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    return keyed.drop("text").join(spans, ["key_id", "key_hash"], "left").withColumn("found", F.coalesce("found", empty))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, per row."""
    base = F.filter("found", lambda x: x["place"] < len(BASE))
    n = lambda place: F.size(F.filter("found", lambda x: x["place"] == place)).cast("long")
    return find_secrets(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets, and ``n_chars`` counted anew.

    Overlapping spans become one, named after the first.  Texts without a span stay as they are, null
    texts stay null, and so do all other columns.
    """
    keyed = row_key(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")))
    spans = find_secrets(docs).where(F.size("found") > 0).groupBy("key_id", "key_hash").agg(F.first("found").alias("_found"))

    def step(done: Column, x: Column) -> Column:
        fresh = x["start"] >= done["at"]
        out = F.when(fresh, F.concat(done["out"], F.col("text").substr(done["at"] + 1, x["start"] - done["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), out.alias("out"))

    made = F.aggregate("_found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.col("text").substr(done["at"] + 1, F.length("text"))))
    joined = keyed.join(spans, ["key_id", "key_hash"], "left")
    new = F.when(F.col("_found").isNotNull(), made).otherwise(F.col("text"))
    joined = joined.select("_row", "_found", new.alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_found").isNotNull(), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return joined.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
