"""Toxicity by two Kneser-Ney bigram models, one of toxic and one of ordinary text.

Both are proper distributions over words given the word before.  A pair's discounted count backs off to
its word's continuation count in the class, in how many different left contexts the word stands; what
that is discounted by goes to the counts of both classes together.  Expressions too rare to tell the
classes apart, by a likelihood ratio test of their counts, are smoothed by the shared counts: such a pair
is left to its word, and the mass of such words in a class is dealt by their shared counts.
A text's score comes from its log-likelihoods under both models, divided by its length, through a fitted
logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import crc_mod, cut
from gradewalk.llm.words import Words, find_words, mix, place, text_chunks, text_of

DISCOUNT = 0.75
FOLDS, HELD_OUT = 5, 0


@dataclass
class KneserNey:
    """Sorted hashes with values by class (rows: ordinary, toxic).

    ``word_p``: probabilities of the telling words, and of the others that end a telling pair; ``rare_p``: of any
    other word, for each shared count of it (a word never seen has one), so that classes differ by one factor there;
    ``given``: discounted shares of the telling pairs; ``left``: what their histories leave to the words.
    """

    words: np.ndarray
    word_p: np.ndarray
    rare_p: np.ndarray
    pairs: np.ndarray
    given: np.ndarray
    histories: np.ndarray
    left: np.ndarray

    def log_ratio(self, w: Words) -> np.ndarray:
        """log P(word | word before) in toxic text less that in ordinary text, for every word."""
        h = w.hash()
        at, known = place(self.words, h)
        p = np.where(known, self.word_p[:, at], self.rare_p[:, None]) if len(self.words) else np.tile(self.rare_p[:, None], len(h))
        if len(h) > 1 and len(self.pairs):
            rows = np.flatnonzero(w.doc[1:] == w.doc[:-1])
            at, follows = place(self.histories, h[rows])
            rows, at = rows[follows], at[follows]
            p[:, rows + 1] *= self.left[:, at]
            at, known = place(self.pairs, pair_hash(h[rows], h[rows + 1]))
            p[:, rows[known] + 1] += self.given[:, at[known]]
        return np.log(p[1]) - np.log(p[0])

    def features(self, w: Words) -> np.ndarray:
        """Per text: the difference of its log-likelihoods by its length, twice: less than nothing and more than it.

        Both are clipped, since a text that repeats one expression says no more by it; texts without words have 0.
        """
        n = np.maximum(np.bincount(w.doc, minlength=w.n_docs), 1)
        mean = np.bincount(w.doc, self.log_ratio(w), minlength=w.n_docs) / n
        return np.stack([np.clip(mean, 0, 0.3), np.clip(mean, -0.3, 0)], axis=1)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + b)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_a_class: int, most_chars: int) -> tuple[DataFrame, float]:
    """Different texts with ``doc_id`` and ``toxic`` (0 or 1), as many of each class, about ``most_a_class`` at most, none over ``most_chars``.

    Equal samples keep continuation counts comparable, as these grow more slowly than the sample.  They're
    drawn by a hash of the id; where ids repeat, the texts are thinned out by their own hash.  Beside them
    the odds of class 1 among all labels.  A document with several labels is toxic if one of them says
    so; null labels and ids say nothing.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = lambda *by: F.pmod(F.xxhash64(*by), F.lit(1_000_000))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}

    def share(counts: dict[int, int]) -> F.Column:
        wanted = min(most_a_class, counts.get(0, 0), counts.get(1, 0))
        parts = [int(1e6 * wanted / max(1, counts.get(c, 0))) for c in (0, 1)]
        return F.when(F.col("toxic") == 1, parts[1]).otherwise(parts[0])

    # twice most_a_class small rows at about the most
    few = F.broadcast(known.where(drawn("doc_id", F.lit(11)) < share(counts)))
    texts = cut(docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(few, "doc_id").groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")))
    found = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    return texts.where(drawn("text", F.lit(13)) < share(found)), (counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring words with their numbers by class."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").fill_null(0))
        for rows, data, first in text_chunks(batch.column("text")):
            w = find_words(data, first)
            h, kind = w.hash(), toxic[rows][w.doc] == 1
            at = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(h) else np.zeros(0, int)
            key, where, back = np.unique(pair_hash(h[at], h[at + 1]), return_index=True, return_inverse=True)
            n = [np.bincount(back[kind[at] == c], minlength=len(key)).astype(np.int64) for c in (False, True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, h[at][where], h[at + 1][where])), *map(pa.array, n)], ["key", "a", "b", "n0", "n1"])


def telling(n0: F.Column, n1: F.Column, total0: float, total1: float) -> F.Column:
    """Twice the log-likelihood ratio of counts in the classes against the classes' shares of all counts."""
    share = total1 / max(1.0, total0 + total1)
    part = lambda x, expected: F.when(x > 0, x * F.log(x / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)
    return 2 * (part(n0, (n0 + n1) * (1 - share)) + part(n1, (n0 + n1) * share))


def fit_kneser_ney(sample: DataFrame, evidence: float = 10.0) -> KneserNey:
    """The models from a bounded sample; expressions below ``evidence`` (see ``telling``; pairs: twice that) are smoothed away.

    Pairs count by their occurrences, words by their different left contexts, which copies of a text don't
    raise.  All counting and testing is done in Spark; only what tells the classes apart comes to the driver.
    """
    counts = sample.select("text", "toxic").mapInArrow(_counts, "key long, a long, b long, n0 long, n1 long")
    pairs = cut(counts.groupBy("key").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    ends = pairs.groupBy("b").agg(F.count_if(F.col("n0") > 0).alias("c0"), F.count_if(F.col("n1") > 0).alias("c1"))
    sums = [float(x or 0) for x in [*ends.agg(F.sum("c0"), F.sum("c1")).first(), *pairs.agg(F.sum("n0"), F.sum("n1")).first()]]
    total, all_pairs = sums[:2], sums[2:]
    ends = ends.withColumn("told", telling(F.col("c0"), F.col("c1"), *total) >= evidence)
    frequent = pairs.where(telling(F.col("n0"), F.col("n1"), *all_pairs) >= 2 * evidence)
    starts = pairs.groupBy("a").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).join(frequent.select("a").distinct(), "a")
    # other words' shared counts cancel out of the classes' ratio, unless a telling pair's share is added to them
    used = ends.join(frequent.select("b").distinct().withColumn("ended", F.lit(True)), "b", "left").where("told or ended").select("b", "c0", "c1", F.col("told").cast("int"))
    e, s, p = _arrays(used), _arrays(starts), _arrays(frequent.select("key", "a", "n0", "n1"))

    all_ends = np.maximum(np.array(total), 1)[:, None]
    words, (c, told) = _sorted(e["b"], [np.stack([e["c0"], e["c1"]]).astype(float), e["told"] == 1])
    known = c[:, told]
    held = DISCOUNT * (known > 0).sum(axis=1, keepdims=True)
    shared = known.sum(axis=0) / max(1.0, known.sum())
    # the others' mass in each class is dealt by their shared counts; words never seen have one such count
    rare = (np.maximum(all_ends[:, 0] - known.sum(axis=1), 0) + 1) / all_ends[:, 0]
    n_rare = max(0.0, sum(total) - known.sum()) + 1
    word_p = rare[:, None] / n_rare * c.sum(axis=0)
    word_p[:, told] = (np.maximum(known - DISCOUNT, 0) + np.maximum(held, DISCOUNT) * shared) / all_ends
    scale = word_p[:, told].sum(axis=1) + rare
    word_p, rare_p = word_p / scale[:, None], rare / n_rare / scale

    histories, (h_total,) = _sorted(s["a"], [np.stack([s["n0"], s["n1"]]).astype(float)])
    pair, (n, a) = _sorted(p["key"], [np.stack([p["n0"], p["n1"]]).astype(float), p["a"]])
    at, _ = place(histories, a.view(np.uint64))
    given = np.maximum(n - DISCOUNT, 0) / np.maximum(h_total[:, at], 1) if len(pair) else np.zeros((2, 0))
    left = np.stack([1 - np.bincount(at, given[k], len(histories)) for k in (0, 1)]) if len(pair) else np.zeros((2, 0))
    return KneserNey(words, word_p, rare_p, pair, given, histories, left)


def _sorted(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys as unsigned numbers in order, and values (last axis) in the same order."""
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], [v[..., order] for v in values]


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    got = df.toArrow()
    return {c: got.column(c).to_numpy().astype(np.int64) for c in df.columns}


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights with the intercept last, by Newton's method."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, most_a_class: int = 8_000, most_chars: int = 20_000, evidence: float = 10.0, row: str | None = None) -> DataFrame:
    """doc_id with ``held_out``, ``score`` in 0 to 1 and ``predicted``, one row per row of ``docs``.

    Learns from about ``most_a_class`` labelled documents of each class, outside the held-out fold and of
    ``most_chars`` at most (bounds of the labelled sample; every text is scored whole); three of four of
    them count words, the fourth sets the curve.  ``row`` names a struct column that holds ``text``; it is
    scored in place of the column ``text`` and is returned too.  Null and empty texts have no evidence and
    get the curve's value at zero.  Without labels of both classes all scores are 0.
    """
    sample, odds = labelled_sample(docs, labels, most_a_class, most_chars)
    for_curve = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = fit_kneser_ney(sample.where(~for_curve), evidence)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measured(texts: pa.Array) -> np.ndarray:
        x = [sent.value.features(find_words(data, first)) for _, data, first in text_chunks(texts)]
        return np.concatenate(x) if x else np.zeros((0, 2))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measured(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "x0", "x1"])

    seen = sample.where(for_curve).select("toxic", "text").mapInArrow(judged, "toxic int, x0 double, x1 double").toPandas()
    y = seen["toxic"].to_numpy(float)
    curve = logistic_fit(seen[["x0", "x1"]].to_numpy(float), y) if 0 < y.sum() < len(y) else np.array([0.0, 0.0, -40.0])
    curve[2] += np.log(odds)
    carry = ["doc_id", *([row] if row else [])]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measured(text_of(batch, row))
            score = 1 / (1 + np.exp(-np.clip(x @ curve[:2] + curve[2], -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(score)], [*carry, "score"])

    made = docs.select(*carry, *([] if row else ["text"])).mapInArrow(scored, docs.select(*carry).schema.add("score", "double"))
    held = (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return made.select(*carry, held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
