"""Fill-in-middle: texts cut into units, rearranged so that the middle comes last, and put back.

A unit grammar is a regular expression whose matches, left to right, are the units.  It is translated to a
zero-width expression that matches between two neighbouring characters of different units, by looking at
their classes alone; splitting there keeps every character.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMMARS = {
    "lines": r"[^\n]*\n|[^\n]+",
    "words": r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "sentences": r"[^.!?\n]*[.!?\n]|[^.!?\n]+",
    "code": r"[A-Za-z0-9_]+|[\x20\x09]+|\n|[^A-Za-z0-9_\x20\x09\n]",
    "characters": r"[\s\S]",
}
_CLASS = r"\[(?:\\.|[^\]\\])+\]|\\.|[^\\\[\]|*+?(){}^$.]"
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Markers:
    """Strings that mark the parts.  No end of one may be the start of another, so that none can arise where texts meet markers."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        all_ = astuple(self)
        if len(set(all_)) < 3 or any(b in a[i:] or b.startswith(a[i:]) for a in all_ for b in all_ for i in range(1, len(a))) or any(a != b and a.startswith(b) for a in all_ for b in all_) or "" in all_:
            raise ValueError("markers must be different and must not overlap")


def boundary(grammar: str) -> str:
    """The zero-width expression for a grammar of alternatives ``C`` (one character), ``C+`` (a run) and ``C*E`` (a run up to an end).

    C and E are characters or classes.  Classes of different alternatives are disjoint, but for a run ``C+``
    that says what a ``C*E`` without its end is.  There is a boundary after every single character and every
    end, and after a run's class where neither that class nor an end of it follows.
    """
    found = [re.fullmatch(rf"(?:(?P<body>{_CLASS})\*)?(?P<last>{_CLASS})(?P<many>\+)?", part) for part in re.findall(rf"(?:{_CLASS}|[*+])+", grammar)]
    if not found or None in found or any(f["body"] and f["many"] for f in found) or "|".join(f[0] for f in found) != grammar:
        raise ValueError(f"not a unit grammar: {grammar}")
    alone = [f["last"] for f in found if not f["many"]]
    runs = {f["last"] if f["many"] else f["body"]: None for f in found if f["many"] or f["body"]}
    ends = {c: [f["last"] for f in found if f["body"] == c] for c in runs}
    cuts = [f"(?<={c})(?={ANY})" for c in alone] + [f"(?<={c})(?!{'|'.join([c, *ends[c]])})(?={ANY})" for c in runs]
    return "|".join(cuts)


def units(text: Column, grammar: str) -> Column:
    """The units of a text as an array; none for an empty text, null for null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text again, from the output and its form alone."""
    p, s, m = astuple(markers)

    def three(x: Column, marks: tuple[str, str, str]) -> list[Column]:
        found, rest = [], x.substr(F.lit(len(marks[0]) + 1), F.length(x))
        for mark in marks[1:]:
            piece = F.substring_index(rest, mark, 1)
            found.append(piece)
            rest = rest.substr(F.length(piece) + len(mark) + 1, F.length(x))
        return [*found, rest]

    prefix, suffix, middle = three(output, (p, s, m))
    suffix2, prefix2, middle2 = three(output, (s, p, m))
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def fill_in_middle(docs: DataFrame, grammar: str = GRAMMARS["lines"], seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: Markers = Markers(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output to every row.

    Four numbers are drawn from the SHA-256 of seed and key: two places among the n + 1 cuts, whether the text
    is rearranged (``rate`` of 100), and whether the suffix comes first (``spm_rate`` of 100).  Texts that are
    empty or hold a marker stay plain, so that ``restored`` gives each text exactly.  A null text is empty, a null
    key the empty string.  Rows of one key are cut alike; repeated rows stay.  Columns of the added names are
    replaced.  Rows are treated where they lie: nothing is shuffled.
    """
    p, s, m = astuple(markers)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long")
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c not in added]
    cut = docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), digest.alias("_digest"))
    cut = cut.withColumn("_units", units(F.col("_text"), grammar)).withColumn("n", F.size("_units").cast("long"))
    one, two = draw(0) % (F.col("n") + 1), draw(1) % (F.col("n") + 1)
    held = F.lit(False)
    for mark in (p, s, m):
        held = held | F.col("_text").contains(mark)
    form = F.when((F.col("_text") == "") | held | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm")
    cut = cut.withColumns({"form": form, "_from": F.least(one, two).cast("int"), "_till": F.greatest(one, two).cast("int")})
    between = lambda a, b: F.array_join(F.slice("_units", a + 1, b - a), "")
    parts = cut.withColumns({"_prefix": between(F.lit(0), F.col("_from")), "_middle": between(F.col("_from"), F.col("_till")), "_suffix": between(F.col("_till"), F.col("n").cast("int"))})
    output = F.when(F.col("form") == "psm", F.concat(F.lit(p), "_prefix", F.lit(s), "_suffix", F.lit(m), "_middle")).when(
        F.col("form") == "spm", F.concat(F.lit(s), "_suffix", F.lit(p), "_prefix", F.lit(m), "_middle")).otherwise(F.col("_text"))
    size = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return parts.select("_row.*", "n", "form", size("_prefix").alias("prefix_chars"), size("_middle").alias("middle_chars"), output.alias("output"))


def middle_report(docs: DataFrame) -> DataFrame:
    """Lines rearranged, with digests of the output and of the text rebuilt from it; odd rows as in ``fill_in_middle``."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
