"""MinHash near-dedup of word-shingle multisets by BagMinHash.

A text is the multiset of its shingles of five words; similarity is the weighted Jaccard index.  The
weight axis is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on.  Each (shingle, interval)
owns a Poisson process whose points come in rising order, each with a signature slot and a place on the
weight axis; a point counts if its place lies below the shingle's weight, so that heavier shingles share
all points of lighter ones.  A slot keeps the smallest point, and two texts agree in a slot with the
probability of their weighted Jaccard index.  Bands of slots propose links, whole multisets verify them.

A multiset is verified as the set of its (shingle, occurrence) pairs: two texts share as many of these as
their multisets overlap.  Each pair is kept as six bytes of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import components, cut, row_key
from gradewalk.llm.words import Words, find_words, mix, text_chunks

SHINGLE, SLOTS, BANDS = 5, 160, 32
ELEMENT = 6  # bytes
SIMILARITY = 0.8


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, times) sorted by text and hash; a text of fewer words has one shingle of all of them."""
    h = w.hash()
    first = np.searchsorted(w.doc, np.arange(w.n_docs))
    count = np.bincount(w.doc, minlength=w.n_docs)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(w.n_docs), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[text]
    key = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < (first + count)[text]
        key = np.where(inside, mix(key + h[np.minimum(at + k, max(len(h) - 1, 0))] + np.uint64(k + 1)), key) if len(h) else key
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else np.zeros(0, int)
    return text[new], key[new], np.diff(np.concatenate([new, [len(key)]]))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def bag_min_hash(text: np.ndarray, key: np.ndarray, times: np.ndarray, n_texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures, a row per text of 64-bit point ids; rows of texts without shingles stay 0."""
    owners, seeds, lows, sizes = [], [], [], []
    low, size, level = 0, 1, 0
    while (more := np.flatnonzero(times > low)).size:
        owners.append(more)
        seeds.append(mix(key[more] + np.uint64(0x51ED270B * (level + 1))))
        lows.append(np.full(len(more), low))
        sizes.append(np.full(len(more), size))
        low, size, level = low + size, max(1, low + size), level + 1
    best = np.full(n_texts * slots, np.inf)
    point = np.zeros(n_texts * slots, np.uint64)
    if not owners:
        return point.reshape(n_texts, slots)
    owner, seed, low, size = (np.concatenate(x) for x in (owners, seeds, lows, sizes))
    when, row, weight = np.zeros(len(owner)), text[owner], times[owner]
    step = 0
    while len(row):
        step += 1
        h = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        when = when - np.log(_uniform(h)) / size
        slot = (mix(h + np.uint64(1)) % np.uint64(slots)).astype(np.int64)
        counts = low + _uniform(mix(h + np.uint64(2))) * size < weight
        at = (row * slots + slot)[counts]
        order = np.lexsort((h[counts], when[counts], at))
        cell = at[order]
        lead = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        cell, t, p = cell[lead], when[counts][order][lead], h[counts][order][lead]
        better = (t < best[cell]) | ((t == best[cell]) & (p < point[cell]))
        best[cell[better]], point[cell[better]] = t[better], p[better]
        live, at = np.unique(row, return_inverse=True)
        on = when < best.reshape(n_texts, slots)[live].max(axis=1)[at]
        seed, low, size, when, row, weight = seed[on], low[on], size[on], when[on], row[on], weight[on]
    return point.reshape(n_texts, slots)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's multiset id (null without a word or an id), its size, the keys of its bands, and the marks that signatures are compared by."""
    for batch in batches:
        for rows, data, first in text_chunks(batch.column("text")):
            w = find_words(data, first)
            text, key, times = shingles(w)
            bags = np.zeros(w.n_docs, np.uint64)
            np.add.at(bags, text, mix(key * np.uint64(2) + times.astype(np.uint64)))
            sizes = np.bincount(text, times, w.n_docs).astype(np.int64)
            whole = bag_min_hash(text, key, times, w.n_docs)
            point = whole.reshape(w.n_docs, BANDS, -1)
            band = np.zeros((w.n_docs, BANDS), np.uint64)
            for k in range(point.shape[2]):
                band = mix(band + point[:, :, k] + np.uint64(k))
            # 16 bits of every slot, then 32 bits of every band
            marks = np.hstack([whole.astype(np.uint16), band.astype(np.uint32).view(np.uint16)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(w.n_docs + 1, dtype=np.int32) * BANDS), pa.array(band.reshape(-1).view(np.int64)))
            part = batch.slice(rows.start, rows.stop - rows.start)
            absent = (sizes == 0) | np.asarray(part.column("doc_id").is_null())
            node = pa.array(mix(bags + sizes.astype(np.uint64)).view(np.int64), mask=absent)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key_hash"), node, pa.array(sizes), lists, pa.array([m.tobytes() for m in marks], pa.binary())], ["doc_id", "key_hash", "node", "size", "bands", "marks"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's (shingle, occurrence) pairs as sorted six-byte hashes."""
    for batch in batches:
        for rows, data, first in text_chunks(batch.column("text")):
            text, key, times = shingles(find_words(data, first))
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            h = mix(np.repeat(key, times) + nth.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - 8 * ELEMENT)
            owner = np.repeat(text, times)
            h = h[np.lexsort((h, owner))]
            raw = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ELEMENT]).tobytes()
            edges = ELEMENT * np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first) - 1))])
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(rows.start, rows.stop - rows.start), pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["node", "elements"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows in a row, and where each row's begin, with the end at last."""
    sizes = np.asarray(pc.binary_length(column)) // ELEMENT
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, ELEMENT)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :ELEMENT] = raw
    return wide.reshape(-1).view("<u8"), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard index of each row's two multisets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            n, pair, keys, total = part.num_rows, [], [], 0
            for column in ("elements_a", "elements_b"):
                h, edges = _unpacked(part.column(column))
                pair.append(np.repeat(np.arange(n), np.diff(edges)))
                keys.append(h)
                total = total + np.diff(edges)
            pair, keys = np.concatenate(pair), np.concatenate(keys)
            order = np.lexsort((keys, pair))
            pair, keys = pair[order], keys[order]
            both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (keys[1:] == keys[:-1])], minlength=n)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both / np.maximum(total - both, 1))], ["a", "b", "likeness"])


def cell_links(side: np.ndarray, root: np.ndarray, marks: np.ndarray, bands: np.ndarray, band: int, h: np.ndarray, edges: np.ndarray, least: float, similarity: float) -> list[tuple[int, int]]:
    """Links (row, row) that join what the whole multisets link among a cell's rows of different classes.

    ``side``: 1 for rows that are compared with those of side 2, 3 for rows compared among each other.
    A pair whose signatures agree in less than ``least`` of the slots, that shares an earlier band or whose
    rows are joined already is passed over; every other one is verified.
    """
    root, found = root.copy(), []
    right = np.flatnonzero(side & 2)
    local = hit = None
    for x in np.flatnonzero(side & 1).tolist():
        y = right[right > x] if side[x] == 3 else right
        y = y[root[y] != root[x]]
        if not len(y):
            continue
        y = y[(marks[y] == marks[x]).mean(axis=1) >= least]
        y = y[(bands[y] == bands[x]).argmax(axis=1) == band] if len(y) else y
        if not len(y):
            continue
        if local is None:
            names, local = np.unique(h, return_inverse=True)
            hit = np.zeros(len(names), bool)
        mine = local[edges[x] : edges[x + 1]]
        hit[mine] = True
        shared = np.array([np.count_nonzero(hit[local[edges[k] : edges[k + 1]]]) for k in y.tolist()])
        hit[mine] = False
        either = len(mine) + edges[y + 1] - edges[y] - shared
        for k in y[shared >= similarity * either].tolist():
            if root[k] != root[x]:
                root[root == root[k]] = root[x]
                found.append((x, k))
    return found


_CELL = ["band", "key", "kind", "i", "j"]


def _linked(batches: Iterator[pa.RecordBatch], least: float, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of the cells whose rows follow each other; a cell may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint16).reshape(rows.num_rows, -1)
        node = rows.column("node").to_numpy()
        found = cell_links(rows.column("side").to_numpy(), rows.column("root").to_numpy(), marks[:, :SLOTS], np.ascontiguousarray(marks[:, SLOTS:]).view(np.uint32), rows.column("band")[0].as_py(), *_unpacked(rows.column("elements")), least, similarity)
        return [(int(node[x]), int(node[y])) for x, y in found]

    def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.stack([np.asarray(batch.column(c)) for c in _CELL])
        edges = np.concatenate([[0], np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        if held and any(held[0].column(c)[0] != batch.column(c)[0] for c in _CELL):
            yield made(links(whole()))
            held = []
        found = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                found.extend(links(whole() if len(held) > 1 else held[0]))
                held = []
        yield made(found)
    if held:
        yield made(links(whole()))


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("marks_a", "marks_b")] if batch.num_rows else [np.zeros((0, 1))] * 2
        good = pa.array((sides[0][:, :SLOTS] == sides[1][:, :SLOTS]).mean(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])


def _judged(pairs: DataFrame, elements: DataFrame, together: int = 1024) -> DataFrame:
    """Pairs (a, b) with their weighted Jaccard index.  An ``a`` of many pairs has a copy for each ``together`` of them."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / together).cast("int").alias("copies"))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    one = elements.select(F.col("node").alias("a"), F.col("elements").alias("elements_a")).join(copies, "a").select("a", "elements_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    rows = dealt.join(elements.select(F.col("node").alias("b"), F.col("elements").alias("elements_b")), "b").join(one, ["a", "copy"])
    return cut(rows.select("a", "b", "elements_a", "elements_b").mapInArrow(_overlap, "a long, b long, likeness double"))


def _cells(open_: DataFrame, block: int, most_bytes: int) -> DataFrame:
    """Deals the rows of buckets (band, key, node, root, size) to cells; a bucket of one class has none.

    A bucket's greatest class isn't compared within itself: blocks of the other rows meet its blocks and
    each other.  A block has about ``block`` rows, fewer if these have long texts.
    """
    classes = open_.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    greatest = F.struct("n", "root")
    mixed = classes.groupBy("band", "key").agg(
        F.max(greatest).alias("main"), F.max_by("size", greatest).alias("main_size"), F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("n") > F.col("main.n"))
    blocks = lambda n, size: F.ceil(F.greatest(n / block, size * ELEMENT / most_bytes)).cast("int")
    mixed = mixed.select("band", "key", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main_size")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main_size")).alias("rests"))
    rows = open_.join(mixed, ["band", "key"]).withColumn("inside", F.col("root") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    own, upto = F.col("own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    places = F.when(F.col("inside"), F.transform(upto("rests"), lambda k: cell(0, k, own, F.lit(2)))).otherwise(F.concat(
        F.transform(upto("mains"), lambda k: cell(0, own, k, F.lit(1))),
        F.transform(upto("rests"), lambda k: cell(1, F.least(own, k), F.greatest(own, k), F.when(own == k, 3).when(own < k, 1).otherwise(2)))))
    return rows.select("band", "key", "node", "root", F.explode(places).alias("c")).select("band", "key", "c.*", "node", "root")


def classified(docs: DataFrame, similarity: float = SIMILARITY, block: int = 1024, most_bytes: int = 8_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, key_hash (of the text, see ``row_key``), component_id and kept; see ``near_duplicates``."""
    # four standard deviations of the estimate below the similarity
    least = similarity - 4 * (similarity * (1 - similarity) / SLOTS) ** 0.5
    texts = row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).drop("key_id")
    signed = cut(texts.mapInArrow(_signed, "doc_id long, key_hash long, node long, size long, bands array<long>, marks binary"))
    some = signed.where(F.col("node").isNotNull())
    nodes = cut(some.groupBy("node").agg(F.min(F.struct("doc_id", "key_hash")).alias("first")))
    single = cut(some.select("node", "size", "bands", "marks").dropDuplicates(["node"]))
    banded = single.select("node", "size", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = cut(banded.join(hubs, ["band", "key"]).select("band", "key", "node", "hub", "size"))
    crowd = buckets.select("node").distinct().join(nodes, "node").select("node", "first.*")
    elements = cut(texts.join(crowd, ["doc_id", "key_hash"]).groupBy("node").agg(F.min("text").alias("text")).mapInArrow(_elements, "node long, elements binary"))
    marks = single.select("node", "marks")
    toward = cut(buckets.where("node <> hub").groupBy("hub", "node").count())

    first = toward.groupBy("node").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("a")).select("a", F.col("node").alias("b"))
    tried = _judged(first, elements)
    # each node has one link here: two steps along them bring most of a class to one root
    good = tried.where(F.col("likeness") >= similarity)
    up = good.select(F.col("a").alias("up"), F.col("b").alias("node"))
    roots = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up", "left").select("node", F.coalesce("far", "up").alias("root"))

    def rooted(df: DataFrame, column: str, into: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(column), F.col("root").alias(into)), column, "left").withColumn(into, F.coalesce(into, column))

    others = rooted(rooted(toward.select(F.col("hub").alias("a"), F.col("node").alias("b")), "a", "root_a"), "b", "root_b").where("root_a <> root_b").select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    likely = others.join(marks.toDF("a", "marks_a"), "a").join(marks.toDF("b", "marks_b"), "b").select("a", "b", "marks_a", "marks_b").mapInArrow(lambda batches: _likely(batches, least), "a long, b long")
    links = tried.union(_judged(cut(likely), elements)).where(F.col("likeness") >= similarity).select("a", "b")
    roots = components(links)

    cells = _cells(rooted(buckets.select("band", "key", "node", "size"), "node", "root"), block, most_bytes)
    met = cells.join(marks.join(elements, "node"), "node").repartition(*_CELL).sortWithinPartitions(*_CELL, "node").select(*_CELL, "side", "node", "root", "marks", "elements")
    more = cut(met.mapInArrow(lambda batches: _linked(batches, least, similarity), "a long, b long"))
    if not more.isEmpty():
        roots = components(links.union(more))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.join(named.groupBy("root").agg(F.min("first").alias("kept_row")), "root").select("node", "kept_row")
    rows = signed.select("doc_id", "key_hash", "node").join(kept, "node", "left")
    here = F.struct("doc_id", "key_hash") == F.col("kept_row")
    return rows.select("doc_id", "key_hash", F.coalesce("kept_row.doc_id", "doc_id").alias("component_id"), F.when(F.col("kept_row").isNull(), True).otherwise(here).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, block: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``component_id`` (smallest doc_id of its class) and ``kept`` (its class keeps this document).

    Texts are compared as multisets of five lower-cased words in a row.  Texts without a word, and null
    texts, link with nothing and are kept.  Rows with a null id have a null class and are kept.  A document
    is an id and a text: rows that agree in both are one document and stay or go together, and two texts
    of one id are two documents, each in its own text's class.  A class keeps the document of its smallest
    id, and of the smallest hash among several texts of that id.

    Texts with equal multisets are one node, named by a 64-bit hash.  The least node of a bucket is its hub.
    First each node is verified against the hub that it shares most buckets with, then against its other
    hubs, unless both are in one class already or their signatures differ too much; so a group of n copies
    makes about n pairs.  Buckets that still hold several classes are dealt to cells of bounded size, where
    every pair of different classes whose signatures agree enough is verified by the whole multisets, which
    come along; a cell gives the links that join its classes, fewer than its rows.  Buckets have no limit.
    """
    return classified(docs, similarity, block).drop("key_hash")
