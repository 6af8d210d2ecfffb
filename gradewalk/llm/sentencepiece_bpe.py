"""SentencePiece encoding and decoding by a max-plus parallel scan.

A piece sequence is the vocabulary's own encoding of a text exactly if every two neighbouring pieces are
the encoding of their concatenation.  So encoding is a best path through the lattice of pieces, where a
step from one piece to the next weighs 0 if they are such neighbours and minus infinity otherwise, and
every prefix has one last piece on its best path.

A giant document is cut into chunks of equal length.  What crosses a cut is the piece that ends at or
after it: the boundary state.  Each chunk yields the transfer matrix from its entry states to its exit
states, as rows.  Neighbouring blocks of chunks are multiplied pairwise in the max-plus sense, in as many
rounds of joins as the number of chunks has binary digits; then the states go back down the same tree,
each block giving its halves their entry and exit states; at last every chunk walks its own part of the
path, apart from the others.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import cut
from gradewalk.llm.words import Table

SPACE = "▁"
#: A piece that stands before the text: nothing precedes.
NONE = ""
_LEAF: dict = {}
#: A run of spaces and what follows: no piece goes past the end of such a stretch.
#: Letters and digits, white space, or others: only between such runs a stretch is looked at for places to cut.
_RUN = re.compile(rf"{SPACE}*[^\W_]+|\s+|{SPACE}+|(?:[^\w\s{SPACE}]|_)+")
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """A byte-pair vocabulary with byte fallback, read from a model file; caches hold ``most`` entries."""

    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.raw = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.most = most
        #: the vocabulary as a tree of characters; the empty string leads to the piece that ends there
        self.tree: dict = {}
        for piece in self.ids:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[NONE] = piece
        #: neighbouring characters within pieces: a text can be cut between all others
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._tree_arrays()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.stretches = Stretches(self)

    def _tree_arrays(self) -> None:
        """The tree's edges (node and character to node) in order, and the piece that ends at each node (-1: none)."""
        edges, ends, todo = [], [-1], [(0, self.tree)]
        while todo:
            at, node = todo.pop()
            for c, below in node.items():
                if c == NONE:
                    ends[at] = self.ids[below]
                else:
                    edges.append((at << 21 | ord(c), len(ends)))
                    todo.append((len(ends), below))
                    ends.append(-1)
        self.edges = Table()
        self.edges.add(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))
        self.ends_here = np.array(ends, np.int64)
        self.sizes = np.zeros(max(self.ids.values()) + 1, np.int64)
        self.sizes[list(self.ids.values())] = [len(p) for p in self.ids]
        self.by_id = {i: p for p, i in self.ids.items()}
        self.fitting = Table()

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The vocabulary's rule itself, for short texts: merge the best-scored pair, leftmost first, until none is left.

        Gives the pieces and the two that were merged last.
        """
        parts, last = list(text), None
        while True:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def made_of(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that are merged into ``piece`` at last; None for a single character or a piece that merging never makes."""
        if len(piece) < 2:
            return None
        if piece not in self.halves:
            parts, last = self.merge(piece)
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether the step weighs 0: the two pieces are the encoding of their concatenation."""
        if left == NONE:
            return len(right) == 1 or self.made_of(right) is not None
        if self.n_pairs >= self.most:
            self.pairs.clear()
            self.n_pairs = 0
        known = self.pairs.setdefault(left, {})
        if right not in known:
            known[right] = self.apart(left, right)
            self.n_pairs += 1
        return known[right]

    def apart(self, left: str, right: str) -> bool:
        """Goes back through the merges that made both pieces: no merge across their border may have come before one of these.

        A merge at a better score comes first, and at the same score the left one does.
        """
        if (len(right) > 1 and self.made_of(right) is None) or (len(left) > 1 and self.made_of(left) is None):
            return False
        score, limit, tie = self.score, -float("inf"), False
        while True:
            across = score.get(left + right)
            if across is not None and (across > limit or (tie and across == limit)):
                return False
            a, b = self.made_of(left), self.made_of(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and score[left] < score[right]):
                left, limit, tie = a[1], score[left], False
            else:
                right, limit, tie = b[0], score[right], True

    def lasts(self, text: str, entry: str, offset: int = 0) -> list[str | None]:
        """The best path's last piece before each place of ``text``, given the piece that ends at ``offset``."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        last[offset] = entry
        tree, pairs, fits = self.tree, self.pairs, self.fits
        for begin in range(offset, n):
            before = last[begin]
            if before is None:
                continue
            node, end, known = tree.get(text[begin], _LEAF), begin + 1, pairs.get(before, _LEAF)
            piece = node.get(NONE) or text[begin]  # a character outside the vocabulary stands alone
            while True:
                if piece is not None and last[end] is None:
                    good = known.get(piece)
                    if good or (good is None and fits(before, piece)):
                        last[end] = piece
                if end == n or not (node := node.get(text[end])):
                    break
                piece, end = node.get(NONE), end + 1
        return last

    def starts(self, text: str, at: int) -> list[str]:
        """Pieces that ``text`` goes on with at a place, the longest last."""
        node, found = self.tree.get(text[at]), []
        if node is None:
            return [text[at]]  # a character outside the vocabulary stands alone
        for k in range(at + 1, len(text) + 1):
            piece = node.get(NONE)
            if piece is not None:
                found.append(piece)
            node = node.get(text[k]) if k < len(text) else None
            if node is None:
                break
        return found

    def path(self, text: str, entry: str = NONE, offset: int = 0) -> list[str]:
        """The best path from ``offset`` to the end, searched depth first and longest piece first.

        As each prefix has one last piece only, a place that leads nowhere is never tried again.
        """
        n, at, before = len(text), offset, entry
        out: list[str] = []
        dead: set[int] = set()
        pairs, fits = self.pairs, self.fits
        open_ = [self.starts(text, at)] if at < n else []
        while at < n:
            known, options = pairs.get(before, _LEAF), open_[-1]
            while options:
                piece = options.pop()
                if dead and at + len(piece) in dead:
                    continue
                good = known.get(piece)
                if good or (good is None and fits(before, piece)):
                    out.append(piece)
                    at, before = at + len(piece), piece
                    if at < n:
                        open_.append(self.starts(text, at))
                    break
            else:
                dead.add(at)
                open_.pop()
                at -= len(out.pop())
                before = out[-1] if out else entry
        return out

    def fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for arrays of ids (-2: nothing precedes)."""
        key = (left + 2) << 21 | right
        good = self.fitting.find(key)
        if (good < 0).any():
            fresh = np.unique(key[good < 0])
            if self.fitting.n > 4 * self.most:
                self.fitting = Table()
                fresh = np.unique(key)
            self.fitting.add(fresh, np.array([self.fits(self.by_id.get((k >> 21) - 2, NONE), self.by_id[k & (1 << 21) - 1]) for k in fresh.tolist()], np.int64))
            good = self.fitting.find(key)
        return good == 1

    def paths(self, texts: list[str]) -> list[bytes]:
        """Ids of the best path of each text, for many short texts at once; all characters must be in the vocabulary.

        All pieces that each text holds are found by going down the tree from every place at once; then
        the places are gone through from left to right, those of all texts in step.
        """
        sizes = np.array(list(map(len, texts)), np.int64)
        stops = np.cumsum(sizes)
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        begin, length = np.arange(len(chars)), 1
        found = []
        node = self.edges.find(chars)
        while len(begin):
            begin, node = begin[node >= 0], node[node >= 0]
            piece = self.ends_here[node]
            some = np.flatnonzero(piece >= 0)
            found.append((begin[some], np.full(len(some), length), piece[some]))
            on = np.flatnonzero(begin + length < stops[text[begin]])
            begin = begin[on]
            node = self.edges.find(node[on] << 21 | chars[begin + length])
            length += 1
        begin, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # each text has one border more than characters
        place_in = begin - (stops - sizes)[text[begin]]
        order = np.argsort(place_in, kind="stable")
        begin, length, piece, place_in = begin[order] + text[begin[order]], length[order], piece[order], place_in[order]
        last = np.full(len(chars) + len(texts), -1, np.int64)
        first = stops - sizes + np.arange(len(texts))
        last[first] = -2
        edges = np.append(np.flatnonzero(np.diff(place_in, prepend=-1)), len(place_in))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            before = last[begin[a:b]]
            some = np.flatnonzero(before != -1) + a
            good = some[self.fit_all(last[begin[some]], piece[some])]
            last[begin[good] + length[good]] = piece[good]
        # backtrace, all texts in step
        sized = self.sizes
        at, row, steps = first + sizes, np.arange(len(texts)), []
        while len(row):
            on = np.flatnonzero(at > first[row])
            at, row = at[on], row[on]
            steps.append((row, at, last[at]))
            at = at - sized[last[at]]
        row, at, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(at, kind="stable")  # borders rise from text to text
        raw = ids[order].astype("<i4").tobytes()
        cuts = 4 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def number(self, pieces: list[str]) -> bytes:
        """Ids; a character outside the vocabulary becomes the ids of its bytes."""
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(i)
        return array("i", out).tobytes()

    def spelled(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        text = self.spelled(ids).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of normalised texts, each of which begins with a space or is empty, and whether the ids spell them."""
        words = [t.split(SPACE)[1:] if SPACE * 2 not in t else [x[1:] for x in _STRETCH.findall(t)] for t in texts]
        self.stretches.learn(set().union(*words))
        ids = [b"".join(map(self.stretches.__getitem__, w)) for w in words]
        return [(i, not self.stretches.wrong or self.spelled(array("i", i)) == t.encode()) for i, t in zip(ids, texts, strict=True)]


class Stretches(dict):
    """Ids of each stretch without its first space, as 32-bit numbers; ``wrong``: the ids of some stretch didn't spell it."""

    def __init__(self, model: Pieces):
        super().__init__()
        self.model, self.wrong = model, False
        self.parts: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        self.learn({text})
        return self[text]

    def learn(self, texts: set[str]) -> None:
        """Cuts stretches where no piece goes on, and encodes the parts that are new together."""
        if len(self) > self.model.most:  # frequent ones are at hand again
            kept = {t: self[t] for t in texts if t in self}
            self.clear()
            self.update(kept)
        # looked up one by one: a set's difference would go through all that is known
        texts = [t for t in texts if t not in self]
        alone = [t for t in texts if t.isalnum()]
        mixed = [t for t in texts if not t.isalnum()]
        inside, parts_of, fresh, known = self.model.inside, [], set(), self.parts
        for text in mixed:
            runs = _RUN.findall(SPACE + text)
            part, parts = runs[0], []
            for run in runs[1:]:
                if part[-1] + run[0] in inside:
                    part += run
                else:
                    parts.append(part)
                    part = run
            parts.append(part)
            parts_of.append(parts)
            fresh.update(parts)
        if len(known) > self.model.most:
            known = self.parts = {p: known[p] for p in fresh if p in known}
        fresh = [p for p in fresh if p not in known]
        self.update(zip(alone, self.encoded([SPACE + t for t in alone]), strict=True))
        known.update(zip(fresh, self.encoded(fresh), strict=True))
        self.update((text, b"".join([known[p] for p in parts])) for text, parts in zip(mixed, parts_of, strict=True))

    def encoded(self, parts: list[str]) -> list[bytes]:
        model = self.model
        strange = set("".join(parts)).difference(model.tree)
        odd = {p for p in parts if len(p) > 64 or not strange.isdisjoint(p)} if strange or max(map(len, parts), default=0) > 64 else set()
        plain = [p for p in parts if p not in odd] if odd else parts
        ids = model.paths(plain) if plain else []
        if odd:
            found = iter(ids)
            ids = [model.number(model.path(p)) if p in odd else next(found) for p in parts]
        self.wrong = self.wrong or model.spelled(array("i", b"".join(ids))) != "".join(parts).encode()
        return ids


def words_of(text: str, offset: int = 0) -> Iterator[tuple[int, int]]:
    """Places from ``offset`` on, cut before each run of spaces: no piece goes on past such a place."""
    begin, at = offset, offset
    while True:
        at = text.find(SPACE, at + 1)
        if at < 0:
            break
        if text[at - 1] != SPACE and at > begin:
            yield begin, at
            begin = at
    if begin < len(text):
        yield begin, len(text)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def safe_places(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """First and last place in ``begin`` to ``end`` (inclusive, past begin) that no piece crosses."""
    found = [at for at in _spaces(text, begin, end) if at > begin and text[at - 1] != SPACE]
    return (found[0], found[-1]) if found else None


def _spaces(text: str, begin: int, end: int) -> Iterator[int]:
    at = text.find(SPACE, begin)
    while 0 <= at <= end:
        yield at
        at = text.find(SPACE, at + 1)


State = tuple[int, str]


def transfer(model: Pieces, before: str, body: str, after: str) -> dict[State, dict[State, int]]:
    """A chunk's transfer matrix between boundary states, without the entries that are minus infinity.

    A state is (how far the piece reaches past the cut, the piece).  ``before`` and ``after`` are the
    neighbouring chunks' next ``longest`` characters; no ``before`` marks a document's first chunk.
    """
    text, cut_in, cut_out = before + body + after, len(before), len(before) + len(body)
    entries: list[State] = [(0, NONE)] if not before else [
        (over, text[cut_in + over - n : cut_in + over]) for over in range(min(model.longest, len(text) - cut_in + 1)) for n in range(over + 1, model.longest + 1)
        if cut_in + over - n >= 0 and (n == 1 or text[cut_in + over - n : cut_in + over] in model.ids)
    ]
    safe = safe_places(text, cut_in, cut_out - 1)
    exits: dict[State, int] | None = None
    out: dict[State, dict[State, int]] = {}
    for over, piece in entries:
        at = cut_in + over
        if safe and at <= safe[0]:
            if model.lasts(text[: safe[0]], piece, at)[safe[0]] is not None:
                exits = exits if exits is not None else _exits(model, text, NONE, safe[1], cut_out, not after)
                out[over, piece] = exits
        elif at > cut_out or (at == cut_out and after):
            out[over, piece] = {(at - cut_out, piece): 0}
        else:
            out[over, piece] = _exits(model, text, piece, at, cut_out, not after)
    return {e: x for e, x in out.items() if x}


def _exits(model: Pieces, text: str, entry: str, at: int, cut: int, final: bool) -> dict[State, int]:
    """States that a path from ``at`` reaches: pieces that begin before the cut and end at or past it."""
    last = model.lasts(text, entry, at)
    if final:
        return {(0, last[cut] or entry): 0} if last[cut] is not None else {}
    return {(k - cut, last[k]): 0 for k in range(cut, len(text) + 1) if last[k] is not None and (k - len(last[k]) < cut)}


def named(state: State) -> str:
    """A state as a join key: how far the piece reaches past the cut, then the piece."""
    return f"{state[0]}|{state[1]}"


def state_of(name: str) -> State:
    over, piece = name.split("|", 1)
    return int(over), piece


def multiplied(level: DataFrame) -> DataFrame:
    """Max-plus products of neighbouring blocks: rows (row, n, block, e, x, weight), ``n`` blocks a document, half as many after it.

    The product is associative, so that the order of the rounds doesn't matter.  A last block without a
    neighbour goes up as it is.
    """
    half = F.expr("block div 2")
    left = level.where((F.col("block") % 2 == 0) & (F.col("block") + 1 < F.col("n"))).select("row", "n", half.alias("block"), "e", F.col("x").alias("mid"), F.col("weight").alias("w0"))
    right = level.where(F.col("block") % 2 == 1).select("row", half.alias("block"), F.col("e").alias("mid"), "x", F.col("weight").alias("w1"))
    both = left.join(right, ["row", "block", "mid"]).groupBy("row", "n", "block", "e", "x").agg(F.max(F.col("w0") + F.col("w1")).alias("weight"))
    alone = level.where((F.col("block") % 2 == 0) & (F.col("block") + 1 >= F.col("n"))).select("row", "n", half.alias("block"), "e", "x", "weight")
    return both.union(alone).withColumn("n", F.expr("(n + 1) div 2").cast("int"))


def handed_down(known: DataFrame, level: DataFrame) -> DataFrame:
    """Entry and exit states (row, block, e, x) of the blocks of ``level``, given those of the products above it."""
    above = known.select("row", F.col("block").alias("up"), F.col("e").alias("e_up"), F.col("x").alias("x_up"))
    sides = level.withColumn("up", F.expr("block div 2"))
    left = sides.where((F.col("block") % 2 == 0) & (F.col("block") + 1 < F.col("n"))).select("row", "up", F.col("e").alias("e_up"), F.col("x").alias("mid"), F.col("weight").alias("w0"))
    right = sides.where(F.col("block") % 2 == 1).select("row", "up", F.col("e").alias("mid"), F.col("x").alias("x_up"), F.col("weight").alias("w1"))
    best = above.join(left, ["row", "up", "e_up"]).join(right, ["row", "up", "x_up", "mid"]).groupBy("row", "up", "e_up", "x_up").agg(F.max_by("mid", F.struct(F.col("w0") + F.col("w1"), "mid")).alias("mid"))
    two = best.select("row", F.explode(F.array(
        F.struct((F.col("up") * 2).alias("block"), F.col("e_up").alias("e"), F.col("mid").alias("x")), F.struct((F.col("up") * 2 + 1).alias("block"), F.col("mid").alias("e"), F.col("x_up").alias("x")))).alias("s")).select("row", "s.*")
    alone = sides.where((F.col("block") % 2 == 0) & (F.col("block") + 1 >= F.col("n"))).select("row", "up", "block").distinct()
    return two.union(above.join(alone, ["row", "up"]).select("row", "block", F.col("e_up").alias("e"), F.col("x_up").alias("x")))


def boundary_states(matrices: DataFrame, most_blocks: int) -> DataFrame:
    """The best path's state at both ends of every chunk, from the chunks' matrices (row, n, block, e, x, weight)."""
    levels = [matrices]
    for _ in range(max(0, most_blocks - 1).bit_length()):
        levels.append(cut(multiplied(levels[-1])))
    start = levels[-1].where(F.col("e") == named((0, NONE)))
    known = start.groupBy("row", "block", "e").agg(F.max_by("x", F.struct("weight", "x")).alias("x"))
    for level in reversed(levels[:-1]):
        known = handed_down(known, level)
    return known


def walk(model: Pieces, chunks: list[tuple[str, str, str, State, State]]) -> list[tuple[bytes, bool]]:
    """Ids of chunks (before, body, after, entry and exit state) between their boundary states, and whether they spell the characters between these.

    What comes before the first place that no piece crosses is searched from the entry state; the rest is encoded as whole texts are, that of all chunks together.
    """
    heads, rest = [], []
    for before, body, after, entry, leave in chunks:
        text = before + body + after
        begin, end = len(before) + entry[0], len(before) + len(body) + leave[0]
        first = begin
        if begin < end and (text[begin] != SPACE or entry[1].endswith(SPACE)):
            first = next(words_of(text[:end], begin))[1]
        ids = model.number(model.path(text[:first], entry[1], begin)) if first > begin else b""
        heads.append((ids, model.spelled(array("i", ids)) == text[begin:first].encode()))
        rest.append(text[first:end])
    return [(head + ids, good and ok) for (head, good), (ids, ok) in zip(heads, model.encode(rest), strict=True)]


ENCODED = "doc_id long, row long, chunk int, n_chars long, n_ids long, ids_crc32 long, ids array<int>, round_trip boolean"
_NAMES = [x.split()[0] for x in ENCODED.split(", ")]


def _rows(batch: pa.RecordBatch, chunk: pa.Array, encoded: list[tuple[bytes, bool]]) -> pa.RecordBatch:
    sizes = np.array([len(x) // 4 for x, _ in encoded], np.int64)
    flat = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(x for x, _ in encoded))])
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
    crc = pa.array([zlib.crc32(x) for x, _ in encoded], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), chunk, batch.column("n_chars"), pa.array(sizes), crc, ids, pa.array([ok for _, ok in encoded], pa.bool_())], _NAMES)


def _encoded(docs: DataFrame, model_path: str, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    """Rows of texts of one chunk, and rows of the other texts' chunks."""
    text = F.coalesce("text", F.lit(""))
    norm = F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))).otherwise(F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"))
    small, giant = base.where(F.col("n_chars") < chunk_chars), base.where(F.col("n_chars") >= chunk_chars)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield _rows(part, pa.array(np.zeros(part.num_rows, np.int32)), model.encode(part.column("norm").to_pylist()))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(model_path).longest
        for batch in batches:
            for r in range(batch.num_rows):
                doc, t, n, row = (batch.column(c)[r].as_py() for c in ("doc_id", "norm", "n_chars", "row"))
                starts = range(0, len(t), chunk_chars)
                for some in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([doc] * len(some), pa.int64()), "row": pa.array([row] * len(some), pa.int64()), "n_chars": pa.array([n] * len(some), pa.int64()), "n": pa.array([len(starts)] * len(some), pa.int32()),
                        "chunk": pa.array([s // chunk_chars for s in some], pa.int32()), "before": [t[max(0, s - reach) : s] for s in some], "body": [t[s : s + chunk_chars] for s in some], "after": [t[s + chunk_chars : s + chunk_chars + reach] for s in some]})

    chunks = cut(giant.select("doc_id", "norm", "n_chars", "row").mapInArrow(chunked, "doc_id long, row long, n_chars long, n int, chunk int, before string, body string, after string"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for r in range(batch.num_rows):
                row, n, chunk, *parts = (batch.column(c)[r].as_py() for c in ("row", "n", "chunk", "before", "body", "after"))
                flat = [(named(e), named(x), w) for e, exits in transfer(model, *parts).items() for x, w in exits.items()]
                size = len(flat)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * size, pa.int64()), pa.array([n] * size, pa.int32()), pa.array([chunk] * size, pa.int32()),
                    pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.string()), pa.array([f[2] for f in flat], pa.int64())], ["row", "n", "block", "e", "x", "weight"])

    first = cut(chunks.select("row", "n", "chunk", "before", "body", "after").mapInArrow(matrices, "row long, n int, block int, e string, x string, weight long"))
    states = boundary_states(first, first.agg(F.max("n")).first()[0] or 0).withColumnRenamed("block", "chunk")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = zip(*(part.column(c).to_pylist() for c in ("before", "body", "after", "e", "x")), strict=True)
                yield _rows(part, part.column("chunk"), walk(model, [(before, body, after, state_of(e), state_of(x)) for before, body, after, e, x in texts]))

    return small.mapInArrow(whole, ENCODED), chunks.join(states, ["row", "chunk"]).mapInArrow(walked, ENCODED)


def encode_documents(docs: DataFrame, model_path: str, chunk_chars: int = 16_384) -> DataFrame:
    """Rows of ``docs`` as chunk rows: doc_id, row, chunk, n_chars, n_ids, ids_crc32, ids and round_trip (the ids spell the chunk's text).

    A text of fewer than ``chunk_chars`` code points is one chunk; the ids of a document's chunks in order
    are its encoding.  Null and empty texts have one chunk without ids.  Spaces in a text and the
    vocabulary's own space letter encode alike, as the vocabulary has it.  ``row`` tells repeated rows apart.
    """
    small, long_ones = _encoded(docs, model_path, chunk_chars)
    return small.union(long_ones)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """Chunk rows (doc_id, row, chunk, ids) with their ``text``; a document's chunks in order are its text.

    An empty list decodes to the empty text; a null one to null.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids if chunk == 0 else [model.ids[SPACE], *ids]) for ids, chunk in zip(batch.column("ids").to_pylist(), batch.column("chunk").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "chunk")), pa.array(texts, pa.string())], ["doc_id", "row", "chunk", "text"])

    return encoded.select("doc_id", "row", "chunk", "ids").mapInArrow(decoded, "doc_id long, row long, chunk int, text string")


def encoding_report(docs: DataFrame, model_path: str, chunk_chars: int = 16_384) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, n_ids, crc32 of each chunk's ids in order, and whether all spell the text."""
    small, long_ones = _encoded(docs, model_path, chunk_chars)
    joined = long_ones.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.sum("n_ids").alias("n_ids"),
        F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids_crc32"))), lambda x: x["ids_crc32"]).alias("chunk_crc32"), F.bool_and("round_trip").alias("round_trip"))
    return small.select("doc_id", "n_chars", "n_ids", F.array("ids_crc32").alias("chunk_crc32"), "round_trip").union(joined.drop("row"))
