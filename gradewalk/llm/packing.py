"""Best-fit packing of tokenised documents into sequences, with swap-based local search.

Each task packs its own documents: best fit decreasing, then moves, one-for-one and two-for-one
exchanges between underfull bins that raise the sum of squared fills, so that fills drift apart until
bins empty.  Bins that stay underfull are dealt out anew and packed together once more.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import cut

CAPACITY, SEPARATOR = 1024, 2
#: A space before white space or the end isn't the first of a token's letters.
_ODD_SPACE = re.compile(r" (?=\s|$)")


class Tokens(dict):
    """Ids of text pieces that begin at a space, as little-endian unsigned 32-bit bytes.

    A space followed by another character than white space always begins a token of this vocabulary's
    splitting rule, so texts can be cut there, and the ids of each distinct piece are kept.
    """

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.most = most
        source = Tokenizer.from_file(path)
        self.source = source
        special = {t.content for t in source.get_added_tokens_decoder().values()}
        self.special = sorted(special)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in source.get_vocab(with_added_tokens=True).items() if piece not in special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = np.array(self.fast.encode_ordinary(piece), "<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a whole text; strings of the tokenizer's special tokens become these tokens, as it has it."""
        if any(map(text.__contains__, self.special)):
            return np.array(self.source.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _ODD_SPACE.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return b"".join([self[first], *map(self.__getitem__, [" " + w for w in rest])]) if text else b""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices; each item goes to the fullest bin that still takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms that some bin has, in order
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, steps_a_bin: int = 8) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise the sum of squared fills.

    The bin to give is the emptiest.  It gives one item to a fuller bin for none (a move), one or two
    smaller ones.  Every underfull bin offers each such return at the item size that would fill the bin to
    the brim with it, so that a bin finds its best partner among all others by looking up its item sizes.
    Each step raises the squared fill; ``steps_a_bin`` steps for each bin at most bound the work.
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    version = [0] * len(bins)
    shelves: dict[int, list[tuple[int, int, tuple[int, ...], int]]] = {}
    brims: list[int] = []  # sizes that some bin asks for, in order

    def offer(b: int) -> None:
        if not 0 < fill[b] < capacity:
            return
        once = sorted({size[i]: i for i in bins[b]}.items())
        returns = [((), 0), *(((i,), n) for n, i in once), *(((i, j), n + m) for k, (n, i) in enumerate(once) for m, j in once[k + 1 :])]
        for back, given in returns:
            brim = capacity - fill[b] + given
            if brim > capacity:
                continue
            if brim not in shelves:
                insort(brims, brim)
                shelves[brim] = []
            shelves[brim].append((b, version[b], back, given))

    def best_step(source: int) -> tuple[int, int, tuple[int, ...], int] | None:
        best, step = 0, None
        for n, item in {size[i]: i for i in bins[source]}.items():
            at = bisect_left(brims, n)
            while at < len(brims) and brims[at] - n < capacity - fill[source]:
                live = shelves[brims[at]] = [x for x in shelves[brims[at]] if x[1] == version[x[0]]]
                if not live:
                    del shelves[brims.pop(at)]
                    continue
                gains = [((n - given) * (fill[b] - fill[source] + n - given), b, back, n - given) for b, _, back, given in live if given < n and b != source and fill[b] >= fill[source]]
                if gains:
                    gain, b, back, more = max(gains)
                    if gain > best:
                        best, step = gain, (item, b, back, more)
                    break
                at += 1
        return step

    for b in range(len(bins)):
        offer(b)
    waiting = [(fill[b], b, 0) for b in range(len(bins)) if 0 < fill[b] < capacity]
    heapify(waiting)
    left = steps_a_bin * len(bins)
    while waiting and left:
        _, source, seen = heappop(waiting)
        if seen != version[source] or not 0 < fill[source] < capacity or not (step := best_step(source)):
            continue
        item, target, back, more = step
        bins[source].remove(item)
        bins[target].append(item)
        for j in back:
            bins[target].remove(j)
            bins[source].append(j)
        fill[source] -= more
        fill[target] += more
        for b in (source, target):
            version[b] += 1
            offer(b)
            heappush(waiting, (fill[b], b, version[b]))
        left -= 1
    return [b for b in bins if b]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    bins = local_search(best_fit_decreasing(sizes, capacity), sizes, capacity)
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += int(sizes[i])
    return where, offset


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, bin long, offset long, fill long"


def _packed(table: pa.Table | pa.RecordBatch, capacity: int, first_bin: int) -> tuple[pa.RecordBatch, int]:
    sizes = np.asarray(table.column("length"))
    where, offset = pack(sizes, capacity)
    fill = np.bincount(where, sizes).astype(np.int64) if len(where) else np.zeros(0, np.int64)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    columns = [table.column(n) for n in names] + [pa.array(where + first_bin), pa.array(offset), pa.array(fill[where])]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [*names, "bin", "offset", "fill"]), first_bin + len(fill)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, together: int = 4096, enough: float = 0.995) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its token ids, then the separator; one longer than ``capacity`` is cut into full pieces,
    the first of which may be shorter.  A null text counts as empty and is its separator alone.  Rows of
    the same id are packed each.  A special token's string in a text counts as that token.  About
    ``together`` documents are packed at once; bins filled less than ``enough`` are packed once more with
    those of other tasks.
    """

    def cut_and_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(tokenizer_path)
        end = np.array([SEPARATOR], "<u4").tobytes()
        held: dict[str, list[int]] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        bins = 0

        def flush(bins: int) -> tuple[pa.RecordBatch, int]:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            table = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held.values(), types, strict=True)], list(held))
            for v in held.values():
                v.clear()
            return _packed(table, capacity, bins)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, text in enumerate(batch.column("text")):
                raw = encoder.ids(text.as_py() or "") + end
                n = len(raw) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for k, v in zip(held, (ids[i], piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                        held[k].append(v)
                if len(held["doc_id"]) >= together:
                    out, bins = flush(bins)
                    yield out
        out, bins = flush(bins)
        yield out

    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_and_packed, PACKED)
    first = cut(first.withColumn("task", F.spark_partition_id()))
    done = F.col("fill") >= int(enough * capacity)
    open_ = first.where(~done)
    groups = max(1, open_.count() // together)
    again = cut(open_.repartition(groups, F.xxhash64("task", "bin", "doc_id", "piece") % groups).select("doc_id", "piece", "start", "length", "ids_crc32")) if groups > 1 else open_.select("doc_id", "piece", "start", "length", "ids_crc32").coalesce(1)

    def packed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, held, n = 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                held.append(batch.slice(at, together))
                n += held[-1].num_rows
                if n >= 2 * together:
                    out, bins = _packed(pa.Table.from_batches(held), capacity, bins)
                    yield out
                    held, n = [], 0
        if held:
            out, bins = _packed(pa.Table.from_batches(held), capacity, bins)
            yield out

    second = again.mapInArrow(packed_again, PACKED).withColumn("task", F.spark_partition_id())
    number = lambda phase: F.col("task").cast("long") * (1 << 33) + F.col("bin") * 2 + phase
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return first.where(done).select(*names, number(0).alias("sequence_id"), "offset").union(second.select(*names, number(1).alias("sequence_id"), "offset"))
