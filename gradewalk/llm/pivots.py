"""Embedding near-dedup through a pivot-permutation index.

Pivots are a bounded sample of the vectors, spread out so that a dense group keeps few.  A vector is
described by its nearest pivots in order; the inverted lists hold, for each pivot, the vectors that are
near it.  Two vectors on a list are candidates if they share enough pivots or lie close around the same
nearest one, and candidates are verified by their cosine.  A pair that shares several lists is judged on
one of them only.  Long lists are cut into blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import components, cut


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Indices of the ``near`` pivots of greatest cosine, nearest first; ties go to the lower index."""
    likeness = unit @ pivots.T
    near = min(near, len(pivots))
    some = np.argpartition(-likeness, near - 1, axis=1)[:, :near]
    some.sort(axis=1)
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(likeness, some, 1), axis=1, kind="stable"), 1)


def ranks_kept(n_pivots: int, near: int = 8) -> int:
    """How many nearest pivots describe a vector: ``near``, and one more for each doubling of the pivots beyond 256.

    The more pivots there are, the fewer of their ``near`` nearest two alike vectors share.
    """
    return near + max(0, int(np.ceil(np.log2(max(1, n_pivots) / 256))))


def spread_pivots(pivots: np.ndarray, least: float) -> np.ndarray:
    """In order, the pivots whose cosine to each one chosen before is below ``least``."""
    free, chosen = np.ones(len(pivots), bool), []
    for k in range(len(pivots)):
        if free[k]:
            chosen.append(k)
            free &= pivots @ pivots[k] < least
    return pivots[chosen]


def fitted(pivots: np.ndarray, size: int) -> np.ndarray:
    """Pivots for vectors of another length: cut, or filled up with zeros."""
    if pivots.shape[1] == size:
        return pivots
    out = np.zeros((len(pivots), size))
    out[:, : pivots.shape[1]] = pivots[:, :size]
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of links that connect what all links connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def link_vectors(vectors: DataFrame, cosine: float = 0.9, near: int = 8, shared: int = 2, a_pivot: int = 64, most_pivots: int = 4096, block: int = 1024) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id and kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; those
    of different lengths don't link.  A vector is described by ``near`` pivots and a few more where there are many
    (``ranks_kept``).  Equal vectors count as links of each other and are indexed once.
    One pivot for ``a_pivot`` distinct vectors of the most common length is sampled by a hash, ``most_pivots``
    at most, and those within twice the link's angle of one chosen before are dropped; vectors of other
    lengths meet the pivots cut or filled up with zeros to their length, in lists of their own.  The vectors
    within that angle of their nearest pivot are at home there: all pairs of the same home are verified.
    Beyond ``4 * a_pivot * most_pivots`` vectors, lists are kept for homes and for pairs of shared pivots in
    place of single ones, so that lists stay short.  Every vector is indexed.  Rows of the same id count one
    by one; a null id keeps a null component.
    """
    usable = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "embedding")
    lone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = rows.where(usable)
    nodes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).withColumn("node", F.struct("node", F.monotonically_increasing_id().alias("nth"))))
    # a node is known by the smallest id of its rows; where ids repeat, several nodes may have the same one
    nodes = nodes.select("embedding", "n", F.col("node.node").alias("vec_id"), F.col("node.nth").alias("node"))
    lengths = nodes.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return lone
    kind = vectors.schema["embedding"].dataType.simpleString()
    n_pivots = min(most_pivots, max(near, lengths["count"] // a_pivot))
    drawn = nodes.where(F.size("embedding") == lengths["size"]).orderBy(F.xxhash64("embedding"), "vec_id").limit(n_pivots).select("embedding").toArrow()
    around = 2 * cosine * cosine - 1 if cosine > 0 else -1.0  # the cosine of twice the link's angle
    pivots = spread_pivots(_unit(_matrix(drawn.column("embedding"))), around)
    near = ranks_kept(len(pivots), near)
    together = min(1 if lengths["count"] <= 4 * a_pivot * most_pivots else 2, len(pivots))
    home_key = sum(most_pivots**k for k in range(together))
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("embedding")))
            for size in np.unique(sizes):
                alike = batch.take(pa.array(np.flatnonzero(sizes == size)))
                own = fitted(sent.value, int(size))
                for at in range(0, alike.num_rows, 2048):
                    part = alike.slice(at, 2048)
                    unit = _unit(_matrix(part.column("embedding")))
                    ranked = nearest_pivots(unit, own, near)
                    home = np.where((unit * own[ranked[:, 0]]).sum(axis=1) >= around, ranked[:, 0], -1)
                    held = np.sort(ranked, axis=1)
                    keys = np.stack([sum(held[:, c].astype(np.int64) * most_pivots**k for k, c in enumerate(pick)) for pick in combinations(range(held.shape[1]), min(together, held.shape[1]))], axis=1)
                    rows = np.repeat(np.arange(part.num_rows), keys.shape[1])
                    keys = keys.reshape(-1)
                    if together > 1:  # a single pivot's list is that of its home too
                        at_home = np.flatnonzero(home >= 0)
                        keys, rows = np.append(keys, home[at_home].astype(np.int64) * home_key), np.append(rows, at_home)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * ranked.shape[1]), pa.array(ranked.reshape(-1).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys), part.column("node").take(pa.array(rows)), lists.take(pa.array(rows)), pa.array(home[rows].astype(np.int32))], ["size", "list", "node", "pivots", "home"])

    postings = cut(nodes.select("node", "embedding").mapInArrow(described, "size int, list long, node long, pivots array<int>, home int"))
    blocks = postings.groupBy("size", "list").agg(F.count("*").alias("n")).where("n > 1").select("size", "list", F.ceil(F.col("n") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        postings.join(blocks, ["size", "list"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .select("size", "list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "pivots", "home")
        .join(nodes.select("node", "n", "embedding"), "node")
    )

    def judged(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c)[0].as_py() for c in ("list", "i", "j"))
        node, n, own, home = (table.column(c).to_numpy() for c in ("node", "n", "own", "home"))
        unit, held = _unit(_matrix(table.column("embedding"))), _matrix(table.column("pivots")).astype(np.int64)
        mine = [key // most_pivots**k % most_pivots for k in range(together)]
        names, local = np.unique(held, return_inverse=True)
        hot = np.zeros((len(node), len(names)), np.float32)
        hot[np.arange(len(node))[:, None], local.reshape(held.shape)] = 1
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        upto = names <= max(mine)
        candidate = hot[left] @ hot[right].T >= min(shared, held.shape[1])
        # the list's pivots are the first that the two share
        candidate &= hot[left][:, upto] @ hot[right][:, upto].T == together
        # or the home of both
        same = (home[left][:, None] == home[right][None, :]) & (home[left] >= 0)[:, None]
        candidate = np.where(same, (home[left].astype(np.int64) * home_key == key)[:, None], candidate)
        if i == j:
            candidate &= node[left][:, None] < node[right][None, :]
        a, b = np.nonzero(candidate & (unit[left] @ unit[right].T >= cosine))
        a, b = left[a], right[b]
        links = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
        tree = _forest(len(node), a, b)
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([node[some], node[a[tree]]])),
            "b": pa.array(np.concatenate([node[some], node[b[tree]]])),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(tree))]).astype(np.int64)),
        })

    found = cut(dealt.groupBy("size", "list", "i", "j").applyInArrow(judged, "a long, b long, links long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b").select("a", "b"))
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").select("embedding", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    classes = cut(named.join(least, "root").select("embedding", "n_links", "component_id"))
    return lone.union(good.join(classes, "embedding").select("vec_id", F.col("n_links").cast("long"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")))
