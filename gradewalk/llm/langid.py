"""Language ID by a linear-chain conditional random field over the words of a text.

Words carry affix, byte-trigram and lexicon features; transitions between the words' languages are
learned from sequences that switch between sampled texts, so code-switched text is labelled by
forward-backward word by word.  A text's language is the one with the greatest mean posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.llm.common import crc_mod
from gradewalk.llm.words import Words, find_words, mix, place, text_chunks, text_of

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 17
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
AFFIXES = [(1, "prefix"), (2, "prefix"), (3, "prefix"), (2, "suffix"), (3, "suffix"), (4, "suffix")]


@dataclass
class Field:
    """Weights of hashed features by language, and log weights of one language following another."""

    langs: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray


def word_features(w: Words, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word's affixes and lexicon entry; buckets of its trigrams; where each word's trigrams begin."""
    h = w.hash()
    _, known = place(lexicon, h)
    columns = [np.where(known, h, np.uint64(1)) % np.uint64(BUCKETS)]
    for k, (size, side) in enumerate(AFFIXES):
        start, end = (w.start, np.minimum(w.start + size, w.end)) if side == "prefix" else (np.maximum(w.end - size, w.start), w.end)
        columns.append(mix(w.hash(start, end) + np.uint64(k + 1)) % np.uint64(BUCKETS))
    n = np.maximum(w.end - w.start - 2, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(begin[-1]) + np.repeat(w.start - begin[:-1], n)
    d = w.data.astype(np.uint64)
    grams = mix(d[at] | d[at + 1] << np.uint64(8) | d[at + 2] << np.uint64(16) | np.uint64(1 << 30)) % np.uint64(BUCKETS) if len(at) else np.zeros(0, np.uint64)
    return np.stack(columns, axis=1).astype(np.int32), grams.astype(np.int32), begin


def emissions(features: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    fixed, grams, begin = features
    sums = np.zeros((len(grams) + 1, weights.shape[1]))
    np.cumsum(weights[grams], axis=0, out=sums[1:])
    return weights[fixed].sum(axis=1) + sums[begin[1:]] - sums[begin[:-1]]


def posteriors(energy: np.ndarray, begins: np.ndarray, transitions: np.ndarray, block: int = 64) -> np.ndarray:
    """Label probabilities of each word given its whole chain; see ``messages``."""
    return messages(energy, begins, transitions, block)[1]


def pair_posteriors(forward: np.ndarray, p: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected number of each transition between neighbouring words (the last axis: all words but the first).

    What a word's label adds from its right is its posterior over the forward message's prediction.
    """
    step = np.exp(transitions)
    pairs = forward[:-1, :, None] * step[None] * (p[1:] / np.maximum(forward[:-1] @ step, 1e-300))[:, None, :]
    return pairs / pairs.sum(axis=(1, 2), keepdims=True)


def messages(energy: np.ndarray, begins: np.ndarray, transitions: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains laid end to end; ``begins`` marks the first word of each.

    Gives the forward messages (label probabilities given the chain so far) and the posteriors.
    The words are cut into equal blocks; each block's product of step matrices is built for all blocks at
    once, the products are chained, and both passes then run in all blocks at once from known ends.
    """
    n, k = energy.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k))
    step = np.exp(transitions - transitions.max())
    nb = -(-n // block)
    e = np.ones((nb * block, k))
    e[:n] = np.exp(energy - energy.max(axis=1, keepdims=True)) + 1e-30
    first = np.zeros(nb * block, bool)
    first[:n] = begins
    first[n : n + 1] = True  # what fills the last block is a chain of its own
    e, first = e.reshape(nb, block, k), first.reshape(nb, block)
    product = np.tile(np.eye(k), (nb, 1, 1))
    for t in range(block):
        after = product @ step
        at = np.flatnonzero(first[:, t])
        after[at] = product[at].sum(axis=2, keepdims=True) / k
        product = after * e[:, t, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    alpha, beta = np.empty((nb, k)), np.empty((nb, k))
    a, b = np.full(k, 1 / k), np.ones(k)
    for i in range(nb):
        alpha[i] = a
        a = a @ product[i]
        a /= a.sum()
    for i in range(nb - 1, -1, -1):
        beta[i] = b
        b = product[i] @ b
        b /= b.max()
    forward = np.empty((nb, block, k))
    for t in range(block):
        before = alpha @ step
        at = np.flatnonzero(first[:, t])
        before[at] = alpha[at].sum(axis=1, keepdims=True) / k
        alpha = before * e[:, t]
        alpha /= alpha.sum(axis=1, keepdims=True)
        forward[:, t] = alpha
    both = np.empty((nb, block, k))
    for t in range(block - 1, -1, -1):
        both[:, t] = forward[:, t] * beta
        down = e[:, t] * beta
        beta = down @ step.T
        at = np.flatnonzero(first[:, t])
        beta[at] = down[at].sum(axis=1, keepdims=True)
        beta /= beta.max(axis=1, keepdims=True)
    p = both.reshape(-1, k)[:n]
    return forward.reshape(-1, k)[:n], p / p.sum(axis=1, keepdims=True)


def fit_field(texts: list[str], langs: list[str], epochs: int = 8, lanes: int = 64, seed: int = 3) -> Field:
    """Fit on texts of known language by stochastic gradient (AdaGrad) on the conditional likelihood.

    Sampled texts are cut into spans of 5 to 80 words and shuffled, so that the chains switch language.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    parts = [find_words(data, first, LETTERS) for _, data, first in text_chunks(pa.array(texts, pa.string()), most_bytes=1 << 40)]
    w = parts[0]
    hashes, counts = np.unique(w.hash(), return_counts=True)
    lexicon = hashes[counts >= 3]
    fixed, grams, begin = word_features(w, lexicon)
    label = np.array([names.index(x) for x in langs])[w.doc]
    cuts = [0]
    while cuts[-1] < len(label):
        cuts.append(cuts[-1] + int(rng.integers(5, 80)))
    cuts = np.unique(np.minimum(np.concatenate([cuts, np.flatnonzero(np.diff(w.doc)) + 1]), len(label)))
    spans = np.split(np.arange(len(label)), cuts[1:-1])
    k = len(names)
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    squares, t_squares = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = np.concatenate([spans[i] for i in rng.permutation(len(spans))])
        for words in np.array_split(order, max(1, len(order) // 20_000)):
            n = begin[words + 1] - begin[words]
            local = np.concatenate([[0], np.cumsum(n)])
            g = grams[np.arange(local[-1]) + np.repeat(begin[words] - local[:-1], n)]
            f = fixed[words]
            begins = np.zeros(len(words), bool)
            begins[:: max(1, len(words) // lanes)] = True
            energy = emissions((f, g, local), weights)
            forward, p = messages(energy, begins, transitions)
            truth = np.zeros_like(p)
            truth[np.arange(len(words)), label[words]] = 1
            slope = p - truth
            keys = np.concatenate([f.ravel(), g])
            owner = np.concatenate([np.repeat(np.arange(len(words)), f.shape[1]), np.repeat(np.arange(len(words)), n)])
            inner = ~begins[1:]
            seen = truth[:-1][inner].T @ truth[1:][inner]
            t_slope = pair_posteriors(forward, p, transitions)[inner].sum(axis=0) - seen
            for c in range(k):
                d = np.bincount(keys, slope[owner, c], BUCKETS) / len(words)
                squares[:, c] += d * d
                weights[:, c] -= 0.3 * d / np.sqrt(squares[:, c])
            t_slope = t_slope / len(words)
            t_squares += t_slope**2
            transitions -= 0.1 * t_slope / np.sqrt(t_squares)
    return Field(names, lexicon, weights.astype(np.float32), transitions)


def learnable(docs: DataFrame, most_chars: int = 20_000) -> DataFrame:
    """The labelled rows that a model may learn from: outside the held-out fold, with a letter, not over ``most_chars``."""
    return docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT) & (F.length("text") <= most_chars) & F.col("text").rlike(r"\p{L}"))


def sampled_field(docs: DataFrame, a_language: int = 200, most_chars: int = 20_000, most_langs: int = 100) -> Field:
    """Fit on ``a_language`` different texts of each language at most, none over ``most_chars``, outside the held-out fold.

    They're drawn by a hash of id and text.  Of the values of ``lang`` the ``most_langs`` with most rows are learned.
    """
    known = learnable(docs, most_chars)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    order = F.xxhash64("doc_id", "text", F.lit(23))
    # twice as many as wanted by share, then the first of each language
    drawn = F.pmod(order, F.lit(1_000_000)) < 2e6 * a_language / F.col("count")
    some = known.select("doc_id", "text", "lang").join(F.broadcast(counts), "lang").where(drawn).groupBy("lang", "text").agg(F.min(order).alias("order"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    rows = some.withColumn("n", first).where(F.col("n") <= a_language).select("lang", "text").orderBy("lang", "text").collect()
    return fit_field([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else Field([], np.zeros(0, np.uint64), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))


def label_texts(texts: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Language index (-1: none) and score of each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False))
    if not field.langs:
        return best, score
    for rows, data, first in text_chunks(texts):
        w = find_words(data, first, LETTERS)
        begins = np.concatenate([[True], w.doc[1:] != w.doc[:-1]]) if len(w.doc) else np.zeros(0, bool)
        p = posteriors(emissions(word_features(w, field.lexicon), field.weights), begins, field.transitions)
        n = np.maximum(np.bincount(w.doc, minlength=w.n_docs), 1)
        mean = np.stack([np.bincount(w.doc, p[:, c], w.n_docs) / n for c in range(len(field.langs))], axis=1)
        best[rows], score[rows] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
    return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def identify_language(docs: DataFrame, a_language: int = 200, most_chars: int = 20_000, row: str | None = None) -> DataFrame:
    """doc_id, ``held_out``, ``lang_pred`` and ``score``, one row per row of ``docs``.

    Learns from at most ``a_language`` texts of each language, none of them over ``most_chars`` (bounds of
    the labelled sample; every text is labelled whole).  ``row`` names a struct column that holds ``text``;
    it is labelled in place of the column ``text`` and is returned too.  ``und`` with score 0 where the text
    is null or has no letter, or where nothing could be learned.  Ties between languages go to the first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sampled_field(docs, a_language, most_chars))
    carry = ["doc_id", *([row] if row else [])]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.langs, "und"], dtype=object)
        for batch in batches:
            best, score = label_texts(text_of(batch, row), sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(names[best], pa.string()), pa.array(score)], [*carry, "lang_pred", "score"])

    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")
    made = docs.select(*carry, *([] if row else ["text"])).mapInArrow(labelled, schema)
    return made.select(*carry, (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
