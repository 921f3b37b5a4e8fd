"""Evaluation texts that appear, fully or partly, in a corpus.

The evaluation texts are the query set: cut into windows of ``window`` words (a shorter text is one
window), each with a SimHash. Every document is cut into windows of the same sizes where it is
scanned. Splitting the 64 bits into radius + 1 blocks, two fingerprints within the radius agree in
at least one block, so looking up every block finds them all. The weighted shingle similarity of
every candidate is then computed exactly.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: words are longest runs of letters and digits, lower-cased.
WORD = re.compile(r"[^\W_]+")
#: Characters of evaluation text looked up in one pass over the documents; more takes more passes.
PASS_CHARS = 8_000_000
#: Words of documents handled at once; a longer text is cut into overlapping parts.
PART = 20_000
#: Candidates gathered at once, and compared at once.
BLOCK, STEP = 1_000_000, 20_000
#: Weight of a word and of a pair of neighbouring words.
ONE, TWO = 1, 2
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of a text as 64-bit hashes; the table of known words is emptied when it grows large."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        found = WORD.findall(text)
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.lower())
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the +1/-1 vectors; 16 bits may wrap, differences of near rows stay right."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    out = np.zeros((len(hashes) + 1, 64), np.int16)
    np.cumsum(bits * np.int8(2) - np.int8(1), axis=0, dtype=np.int16, out=out[1:])
    return out


def _pairs(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h[:-1] * _PAIR) ^ (h[1:] + (h[:-1] >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(31))) * _PAIR
        return x ^ (x >> np.uint64(30))


class Sums:
    """Sums over a run of words from which windows of any size get their fingerprints."""

    def __init__(self, h: np.ndarray) -> None:
        self.n, self.one = len(h), _signs(h)
        self.two = _signs(_pairs(h)) if len(h) > 1 else np.zeros((1, 64), np.int16)

    def fingerprints(self, size: int) -> np.ndarray:
        m = self.n - size + 1
        total = (self.one[size:] - self.one[:m]) * np.int16(ONE)
        if size > 1:
            total += (self.two[size - 1 :] - self.two[:m]) * np.int16(TWO)
        return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted shingle similarity: words and neighbouring pairs, shared weight over joint weight."""
    def shingles(h: np.ndarray) -> Counter:
        return Counter({**{("w", k): v * ONE for k, v in Counter(h.tolist()).items()}, **{("p", k): v * TWO for k, v in Counter(_pairs(h).tolist() if len(h) > 1 else []).items()}})

    x, y = shingles(a), shingles(b)
    return (x & y).total() / (x | y).total()


def losses(size: int, least: float) -> int:
    """The greatest weight that a window of ``size`` words can lose at a similarity of ``least``."""
    whole = size * ONE + (size - 1) * TWO
    return next(x for x in range(whole, -1, -1) if (whole - x) / (whole + x) >= least)


def _ranks(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value of a row."""
    return np.stack([(x[:, :j] == x[:, j : j + 1]).sum(axis=1) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros(x.shape, np.int64)


def _row_pairs(x: np.ndarray) -> np.ndarray:
    """The neighbouring pairs of each row."""
    n, m = x.shape
    flat = _pairs(x.ravel()) if x.size > 1 else np.zeros(0, np.uint64)
    return np.append(flat, np.uint64(0)).reshape(n, m)[:, : m - 1] if n else np.zeros((0, m - 1), np.uint64)


class Windows:
    """The windows of one size: word hashes in rows, and the item of each."""

    def __init__(self, size: int, rows: np.ndarray, items: np.ndarray) -> None:
        self.size, self.rows, self.items = size, rows, items
        self.pairs = _row_pairs(rows)
        self.word_ranks, self.pair_ranks = _ranks(rows), _ranks(self.pairs)

    def similarities(self, h: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """``similarity`` of the words from each position on with a window each."""
        whole = self.size * ONE + (self.size - 1) * TWO
        out = np.zeros(len(at))
        for k in range(0, len(at), STEP):
            b = window[k : k + STEP]
            mine = h[at[k : k + STEP, None] + np.arange(self.size)]
            # a repeated shingle counts as often as both hold it
            shared = ((self.rows[b][:, :, None] == mine[:, None, :]).sum(axis=2) > self.word_ranks[b]).sum(axis=1) * ONE
            if self.size > 1:
                shared += ((self.pairs[b][:, :, None] == _row_pairs(mine)[:, None, :]).sum(axis=2) > self.pair_ranks[b]).sum(axis=1) * TWO
            out[k : k + STEP] = shared / (2 * whole - shared)
        return out


class HashedWindows(Windows):
    """Windows found by their SimHashes, with an index per block of bits."""

    def __init__(self, size: int, rows: np.ndarray, items: np.ndarray, radius: int) -> None:
        super().__init__(size, rows, items)
        self.radius = radius
        self.prints = np.concatenate([Sums(r).fingerprints(size) for r in rows]) if len(rows) else np.zeros(0, np.uint64)
        self.width = 64 // (radius + 1)
        self.blocks = []
        for b in range(radius + 1):
            key = self._key(self.prints, b)
            order = np.argsort(key, kind="stable")
            keys, start, count = np.unique(key[order], return_index=True, return_counts=True)
            there = np.zeros(1 << 16, bool)
            there[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.blocks.append((there, keys, start, count, order))

    def _key(self, prints: np.ndarray, b: int) -> np.ndarray:
        last = b == self.radius
        cut = prints >> np.uint64(b * self.width)
        return cut if last else cut & np.uint64((1 << self.width) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position in prints, window) within the radius, each once."""
        found = []
        for b, (there, keys, start, count, order) in enumerate(self.blocks):
            key = self._key(prints, b)
            at = np.flatnonzero(there[(key & np.uint64(0xFFFF)).astype(np.int64)])
            slot = np.searchsorted(keys, key[at])
            slot[slot == len(keys)] = 0
            hit = keys[slot] == key[at]
            at, slot = at[hit], slot[hit]
            many = count[slot]
            who = np.repeat(at, many)
            first = np.repeat(start[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(at) else np.zeros(0, np.int64)
            window = order[first + np.arange(len(who))]
            close = np.bitwise_count(prints[who] ^ self.prints[window]) <= self.radius
            found.append(who[close].astype(np.int64) * len(self.prints) + window[close])
        both = np.unique(np.concatenate(found))
        return both // len(self.prints), both % len(self.prints)

    def verified(self, prints: np.ndarray, h: np.ndarray, part: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in h, window, similarity) of the windows within the radius that are similar."""
        at, win = self.near(prints)
        inside = part[at] == part[at + self.size - 1]  # a window doesn't run over into the next text
        at, win = at[inside], win[inside]
        s = self.similarities(h, at, win)
        good = s >= least
        yield at[good], win[good], s[good]


class SimilarWindows(Windows):
    """Windows found by shingles that a similar window can't all lack.

    A window that keeps the similarity loses at most ``losses`` in weight, so at most that over
    ``TWO`` pairs. One pair more of each window, the rarest among all windows, goes to the table;
    where a window hasn't so many pairs, words take their place. No similar window is missed.
    """

    def __init__(self, size: int, rows: np.ndarray, items: np.ndarray, least: float) -> None:
        super().__init__(size, rows, items)
        self.least = least
        lost = losses(size, least)
        self.span = 2 if lost // TWO < size - 1 else 1
        shingles, need = (self.pairs, lost // TWO + 1) if self.span == 2 else (rows, min(lost // ONE, size - 1) + 1)
        values, back, count = np.unique(shingles, return_inverse=True, return_counts=True)
        rarest = np.argsort(count[back.reshape(shingles.shape)], axis=1, kind="stable")[:, :need]
        key = np.take_along_axis(shingles, rarest, axis=1).ravel()
        window = np.repeat(np.arange(len(rows)), need)
        order = np.argsort(key, kind="stable")
        self.keys, self.start, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.windows = window[order]
        self.there = np.zeros(1 << 16, bool)
        self.there[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def near(self, h: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All (position in h, window, similarity) of at least ``least``, each once, in blocks."""
        shingles = _pairs(h) if self.span == 2 else h
        at = np.flatnonzero(self.there[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.searchsorted(self.keys, shingles[at])
        slot[slot == len(self.keys)] = 0
        hit = self.keys[slot] == shingles[at]
        at, slot = at[hit], slot[hit]
        fan = self.count[slot] * (self.size - self.span + 1)
        ends = np.cumsum(fan)
        lo = 0
        while lo < len(at):
            # a block ends at a shingle, its last windows may come again in the next: best of both is kept
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")))
            yield from self._verified(h, part, at[lo:hi], slot[lo:hi])
            lo = hi

    def _verified(self, h: np.ndarray, part: np.ndarray, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        many = self.count[slot]
        before = np.cumsum(many) - many
        window = self.windows[np.repeat(self.start[slot] - before, many) + np.arange(many.sum())]
        back = np.arange(self.size - self.span + 1)
        p = (np.repeat(at, many)[:, None] - back).ravel()
        w = np.repeat(window, len(back))
        ok = (p >= 0) & (p + self.size <= len(h))
        p, w = p[ok], w[ok]
        ok = part[p] == part[p + self.size - 1]  # a window doesn't run over into the next text
        both = np.unique(p[ok].astype(np.int64) * len(self.rows) + w[ok])
        p, w = both // len(self.rows), both % len(self.rows)
        s = self.similarities(h, p, w)
        good = s >= self.least
        yield p[good], w[good], s[good]


def _indexes(items: list[tuple[int, str]], window: int, radius: int | None, least: float) -> list[Windows]:
    words, by_size = Words(), {}
    for item, text in items:
        h = words(text)
        size = min(window, len(h))
        if size:
            rows = by_size.setdefault(size, {})
            for at in range(len(h) - size + 1):
                rows[(h[at : at + size].tobytes(), item)] = None
    made = [(s, np.frombuffer(b"".join(r[0] for r in rows), np.uint64).reshape(-1, s), np.array([r[1] for r in rows], np.int64)) for s, rows in by_size.items()]
    return [SimilarWindows(*x, least) if radius is None else HashedWindows(*x, radius) for x in made]


#: The indexes a worker made last, by the number of their broadcast; they last over tasks.
_WORKER: dict[tuple, list[Windows]] = {}


def _kept(key: tuple, items: list[tuple[int, str]], window: int, radius: int | None, least: float) -> list[Windows]:
    if key not in _WORKER:
        _WORKER.clear()  # one collection of items at a time, so the room stays bounded
        _WORKER[key] = _indexes(items, window, radius, least)
    return _WORKER[key]


def leaked_items(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", window: int = 12, radius: int | None = None, least: float = 0.8) -> DataFrame:
    """(doc, item, similarity, verbatim) for every document and item with a similar window.

    A window is ``window`` consecutive words, or all words of a shorter item. ``similarity`` is the
    best weighted shingle similarity of the two, at least ``least`` (above 0). With a ``radius`` the
    candidates are windows whose SimHashes differ in at most so many bits; identical windows always
    do, of others only some. Without one they come from ``SimilarWindows``, which misses none. Either
    way every candidate's similarity is computed before it counts. ``verbatim`` tells whether a window
    occurs word for word. Texts that are null or have no word match nothing; repeated ids
    give one row; an empty table gives none.

    Documents are neither shuffled nor collected; only the found pairs are made distinct. The items
    are a stated query set: they go to the tasks in passes of ``PASS_CHARS`` characters, so what is
    broadcast stays below a fixed size however many items there are.
    """
    if radius is not None and not 0 <= radius <= 15:
        raise ValueError("radius must lie between 0 and 15")
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    sc = documents.sparkSession.sparkContext
    asked = items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t"))
    passes = max(1, -(-int(asked.agg(F.sum(F.length("t"))).first()[0] or 0) // PASS_CHARS))
    kind = documents.schema[doc].dataType.simpleString()
    out = None
    for k in range(passes):
        part = asked.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        sent = sc.broadcast([(r.i, r.t) for r in part.collect()])
        made = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, made=made) -> Iterator[pa.RecordBatch]:
            indexes = _kept((made,), sent.value, window, radius, least)
            words = Words()
            for batch in batches:
                yield from _scan(batch, indexes, words, window, least, doc, item)

        got = documents.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(doc, text).mapInArrow(run, f"`{doc}` {kind}, `{item}` bigint, similarity double, verbatim boolean")
        out = got if out is None else out.unionByName(got)
    return out.groupBy(doc, item).agg(F.max("similarity").alias("similarity"), F.max("verbatim").alias("verbatim"))


def _scan(batch: pa.RecordBatch, indexes: list[Windows], words: Words, window: int, least: float, doc: str, item: str) -> Iterator[pa.RecordBatch]:
    pieces: list[tuple[int, np.ndarray]] = []
    held = 0
    best: dict[tuple[int, int], tuple[float, bool]] = {}

    def flush() -> None:
        nonlocal held
        h = np.concatenate([p for _, p in pieces])
        owner = np.repeat(np.array([r for r, _ in pieces]), [len(p) for _, p in pieces])
        part = np.repeat(np.arange(len(pieces)), [len(p) for _, p in pieces])
        sums = Sums(h) if any(isinstance(ix, HashedWindows) for ix in indexes) else None
        for ix in indexes:
            if len(h) < ix.size:
                continue
            for at, win, likes in ix.near(h, part) if isinstance(ix, SimilarWindows) else ix.verified(sums.fingerprints(ix.size), h, part, least):
                same = (h[at[:, None] + np.arange(ix.size)] == ix.rows[win]).all(axis=1)
                for r, i, s, v in zip(owner[at].tolist(), ix.items[win].tolist(), likes.tolist(), same.tolist()):
                    had = best.get((r, i), (0.0, False))
                    best[(r, i)] = (max(had[0], s), had[1] or v)
        pieces.clear()
        held = 0

    for row, value in enumerate(batch.column(1)):
        h = words(value.as_py())
        for at in range(0, len(h), PART):
            piece = h[at : at + PART + window - 1]
            if at and len(piece) < window:
                continue  # held whole by the part before
            pieces.append((row, piece))
            held += len(piece)
            if held >= PART:
                flush()
    if pieces:
        flush()
    if best:
        rows = pa.array([r for r, _ in best])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([i for _, i in best], pa.int64()), pa.array([s for s, _ in best.values()], pa.float64()), pa.array([v for _, v in best.values()], pa.bool_())], names=[doc, item, "similarity", "verbatim"])
