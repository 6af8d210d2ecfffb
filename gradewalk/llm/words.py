"""Words of Arrow text columns as numpy arrays: places, hashes and features of whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Letters and digits of ASCII, and every byte of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Everything but space and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of some texts: ``data`` holds all bytes, ``first`` where each text begins, with the end at last."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sums: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def hash(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges (default: the words), equal for equal bytes."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        inverse = _powers_to(len(self.data) + 1)[1]
        return mix((self.sums[end] - self.sums[start]) * inverse[start])


def find_words(data: np.ndarray, first: np.ndarray, inside: np.ndarray = ALNUM) -> Words:
    """Maximal runs of ``inside`` bytes, within each text."""
    mask = inside[data]
    before = np.empty(len(mask), bool)
    before[:1], before[1:] = False, mask[:-1]
    before[first[first < len(mask)]] = False
    after = np.empty(len(mask), bool)
    after[-1:], after[:-1] = False, mask[1:]
    after[first[first > 0] - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_to(len(data) + 1)[0][: len(data)], out=sums[1:])
    return Words(data, first, start, end, np.searchsorted(first, start, "right") - 1, sums)


def text_chunks(texts: pa.Array, lower: str | None = "utf8", most_bytes: int = 2_000_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts in slices of about ``most_bytes`` (a longer text alone), as (rows, bytes, offsets).

    ``lower``: "utf8" lower-cases all letters, "ascii" A to Z, None nothing.  Null texts are empty.
    """
    texts = pc.fill_null(texts, "")
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts)))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most_bytes, "right")) - 1)
        part = texts.slice(at, to - at)
        if lower:
            part = pc.utf8_lower(part) if lower == "utf8" else pc.ascii_lower(part)
        part = part.cast(pa.large_string())
        _, ends, data = part.buffers()
        first = np.frombuffer(ends, np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, np.uint8)[first[0] : first[-1]] if data is not None else np.zeros(0, np.uint8)
        yield slice(at, to), raw, first - first[0]
        at = to


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


def place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def text_of(batch: pa.RecordBatch, row: str | None) -> pa.Array:
    """The texts of a batch: its column ``text``, or that field of the struct column ``row``."""
    return pc.struct_field(batch.column(row), "text") if row else batch.column("text")


class Table:
    """Numbers (0 and up) by keys (0 and up), looked up for whole arrays: an open hash table of two arrays."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 where there is none."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.keys) - 1)
            held = self.keys[slot]
            same = held == keys[open_]
            out[open_[same]] = self.values[slot[same]]
            on = ~same & (held >= 0)
            open_, slot = open_[on], slot[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that aren't in the table yet."""
        if 3 * (self.n + len(keys)) > len(self.keys):
            full = self.keys >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self.__init__(max(12, int(4 * len(keys)).bit_length()))
        self.n += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            on = np.ones(len(keys), bool)
            on[put] = False
            keys, values, slot = keys[on], values[on], (slot[on] + 1) & (len(self.keys) - 1)
