"""All pairs of records whose sets of terms are similar, by vantage-point trees over fingerprints.

A record's fingerprint has a bit per hash bucket, telling whether an odd number of its terms fall
there. One term more or less flips one bit, so the Hamming distance of two fingerprints never
exceeds the number of terms they do not share, and a similarity of t allows at most
(1 - t) / (1 + t) of the two sizes' sum. That bound is the radius of the search: triangle bounds
prune branches without losing a pair.

With sets this large the distances of unrelated records lie so close together that one tree over
everything prunes nothing. So records are first put into shards that overlap. All terms have one
order, rare ones first; of n terms a record shares at least ceil(t n) with any similar one, so the
first term two similar records share is among the n - ceil(t n) + 1 first terms of both, and each
record goes to the shards of these. Where that term stands tells how many terms before it are not
shared by either side: they are taken off the radius, and the fingerprint only covers the terms
after it. In a shard of a rare term the radius is wide but the shard small, in one of a common term
the shard is large but the radius narrow, which is where trees prune. A shard of too many records
is replaced by those of the second term shared, and so on; see ``Shards``. Every shard is searched
with a tree of its own, and what the trees yield is compared exactly. Nothing depends on chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.terms import TERM, joined_text
from barlight.operators.components import connected_components
from barlight.session import discard, stored, written

#: Bits of a fingerprint, 64 or 128. More bits leave fewer candidates to compare, and longer rows to shuffle.
BITS = 128
#: Counters by which terms and shards are told to be rare or large: 2 to this power, whatever the
#: collection's size. Several may share a counter; that costs time in a very large collection, no pair.
COUNTERS = 22
#: A shard of more rows is replaced by shards of one more shared term, up to so many terms; beyond, it
#: is split into blocks, each pair of blocks being searched apart.
SHARD, TERMS = 8192, 4
#: Rows of a leaf at most.
LEAF = 16
#: Records handled at once; rows of shards held at once, unless one shard needs more.
RECORDS, HELD = 2000, 20_000
#: Pairs of branches followed at once, and pairs of rows compared at once.
STEP = 1 << 16
#: Bytes of shards' rows, or of terms, shuffled at once in a small collection; in a larger one as many as
#: the table of sets has. What is more goes in passes, whose shuffle files are removed one after another.
PASS = 64_000_000
#: Passes in which copies of a set are left out, and links verified, at most; bytes of a shard's row once compressed.
OWNERS, ROW = 6, 32

#: What a shard holds of a record: key, number of terms, how many of them stand before the shard's
#: and are not shared, and the fingerprint of those after it, packed into one value.
_BODY = np.dtype([("key", "<i8"), ("n", "<i4"), ("front", "<i4"), ("bits", "<u8", BITS // 64)])
_OUT = pa.schema([("kind", pa.int8()), ("shard", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("body", pa.binary())])
_OUT_DDL = "kind tinyint, shard bigint, a bigint, b bigint, body binary"
_ROWS_DDL = "shard bigint, body binary"
_SETS_DDL = "key bigint, d1 bigint, d2 bigint, terms array<bigint>"
_SHIFT = np.uint64(64 - COUNTERS)
_EPS = 1e-9


def _packed(body: np.ndarray) -> pa.Array:
    ends = np.arange(0, _BODY.itemsize * len(body) + 1, _BODY.itemsize, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body).tobytes())])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class VantageForest:
    """One multi-vantage-point tree per shard, all built and searched together, a level at a time.

    ``length`` rows of each shard lie one after another: ``prints`` (64-bit words), ``n`` terms,
    ``front`` of them known not to be shared. A pair of a shard is sought if its distance is at most
    the sum of both sides' ``slack``, the part of the radius left to each. A tree has three vantage
    points: the empty set, the first row, and the row farthest from that. Its levels part the rows by
    slack and by their Hamming distance to each of them, into leaves of up to ``LEAF`` rows. Every
    branch knows its ranges of distance and its greatest slack. Two branches are followed together, as
    long as the triangle bounds allow a pair between them; what two leaves hold is compared.
    """

    def __init__(self, length: np.ndarray, prints: np.ndarray, n: np.ndarray, front: np.ndarray, least: float) -> None:
        self.n, self.least = n.astype(np.float64), least
        slack = (1 - least) / (1 + least) * self.n - front
        # a single precision number that is surely not below it; the last row stands for no row
        self.slack = np.append(slack + 1e-6 * self.n + 1e-3, -1e8).astype(np.float32)
        # in sixteenths, rounded up; small numbers take half the room
        kind = np.int16 if not len(n) or np.abs(slack).max() < 1000 else np.int32
        self.parts = np.ceil(16 * np.maximum(self.slack, -2000 if kind == np.int16 else -1e8)).astype(kind)
        self.words = [np.append(np.ascontiguousarray(prints[:, w]), np.uint64(0)) for w in range(prints.shape[1])]
        self.buffers = [np.empty(STEP, t) for t in (np.uint64, np.uint8, np.uint8, kind)]
        self.length, self.compared = length.astype(np.int64), 0
        start = np.cumsum(self.length) - self.length
        one = np.repeat(start, self.length)
        first = self._distance(np.arange(len(n)), one)
        by = np.lexsort((first, one))
        two = by[start + self.length - 1] if len(length) else start
        self.points = np.stack([n - front, first, self._distance(np.arange(len(n)), np.repeat(two, self.length))], axis=1).astype(np.int32)

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(w[a] ^ w[b]).astype(np.int32) for w in self.words), np.zeros(len(a), np.int32))

    def _leaves(self) -> None:
        """Parts the rows of every shard level by level; a level's nodes have their children in a row."""
        order = np.arange(int(self.length.sum()))
        s, m = np.cumsum(self.length) - self.length, self.length
        self.levels = []
        axes = 1 + self.points.shape[1]
        for axis in range(axes):
            fan = np.ceil(np.ceil(m / LEAF) ** (1 / (axes - axis)) - 1e-9).astype(np.int64)
            large = np.flatnonzero(fan > 1)
            pos = _ranges(s[large], m[large])
            row = order[pos]
            value = self.slack[row] if axis == 0 else self.points[row, axis - 1]
            order[pos] = row[np.lexsort((value, np.repeat(large, m[large])))]
            child = np.cumsum(fan) - fan
            which = _ranges(np.zeros(len(fan), np.int64), fan)
            ms, ss, fs = (np.repeat(x, fan) for x in (m, s, fan))
            lo, hi = ms * which // fs, ms * (which + 1) // fs
            s, m = ss + lo, hi - lo
            at = np.append(order, 0)
            low = np.minimum.reduceat(self.points[at[:-1]], s) if len(s) else self.points
            high = np.maximum.reduceat(self.points[at[:-1]], s) if len(s) else self.points
            most = np.maximum.reduceat(self.slack[at[:-1]], s) if len(s) else self.slack
            self.levels.append((child, fan, low, high, most))
        self.order, self.start, self.size = order, s, m

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a shard within the radius, each once."""
        self._leaves()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        todo = [(0, np.arange(len(self.length)), np.arange(len(self.length)))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > STEP:
                todo.append((level, a[STEP:], b[STEP:]))
                a, b = a[:STEP], b[:STEP]
            if level == len(self.levels):
                found += self._compared(a, b)
                continue
            child, fan, low, high, most = self.levels[level]
            both = fan[a] * fan[b]
            i = _ranges(np.zeros(len(a), np.int64), both)
            wide = np.repeat(fan[b], both)
            x, y = np.repeat(child[a], both) + i // wide, np.repeat(child[b], both) + i % wide
            radius = most[x] + most[y]
            ok = np.flatnonzero((radius >= 0) & (x <= y))
            x, y, radius = x[ok], y[ok], radius[ok]
            for p in range(low.shape[1]):
                ok = np.flatnonzero((low[x, p] - high[y, p] <= radius) & (low[y, p] - high[x, p] <= radius))
                x, y, radius = x[ok], y[ok], radius[ok]
            if len(x):
                todo.append((level + 1, x, y))
        a, b = (np.concatenate(x) for x in zip(*found))
        return a, b

    def _compared(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of two leaves each, or of a leaf with itself, within the radius."""
        size = np.maximum(self.size[a], self.size[b])
        self.compared += int(np.where(a == b, self.size[a] * (self.size[a] - 1) // 2, self.size[a] * self.size[b]).sum())
        for width in np.unique(size).tolist():
            of = np.flatnonzero(size == width)
            step = max(1, STEP // (width * width))
            for lo in range(0, len(of), step):
                yield from self._block(a[of[lo : lo + step]], b[of[lo : lo + step]], width)

    def _block(self, a: np.ndarray, b: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # the leaves lie along the last axis, the longest, over which the loops are fast
        at, sides = np.arange(width)[:, None], []
        for leaf in (a, b):
            sides.append(np.where(at < self.size[leaf], self.order[np.minimum(self.start[leaf] + at, len(self.order) - 1)], len(self.n)))
        x, y = sides
        bits, one, d, allowed = (buffer[: len(a) * width * width].reshape(width, width, len(a)) for buffer in self.buffers)
        for k, w in enumerate(self.words):
            np.bitwise_xor(w[x][:, None, :], w[y][None, :, :], out=bits)
            np.bitwise_count(bits, out=one if k else d)
            if k:
                np.add(d, one, out=d)
        np.add(self.parts[x][:, None, :], self.parts[y][None, :, :], out=allowed)
        np.right_shift(allowed, 4, out=allowed)
        at, leaf = np.divmod(np.flatnonzero(np.less_equal(d, allowed).ravel()), len(a))
        i, j = np.divmod(at, width)
        ok = (a[leaf] != b[leaf]) | (i < j)
        i, j = x[i[ok], leaf[ok]], y[j[ok], leaf[ok]]
        p, q = self.n[i], self.n[j]
        ok = np.minimum(p, q) >= self.least * np.maximum(p, q) - _EPS
        yield i[ok], j[ok]


class Shards:
    """Which shards records go to.

    ``order`` has a rank per counter, rare terms having low ones; terms are ordered by it, then by
    hash. ``states`` has per counter, for shards of one shared term, of two and so on, whether they
    hold one record (0), some (1) or too many (2), which are replaced by those of one more term.
    That decision belongs to the shard, so both sides of a pair follow it to the same shard. Of
    ``parts`` of all shards, by the first term shared, only those of one ``part`` are given.
    """

    def __init__(self, least: float, order: np.ndarray, states: list[np.ndarray], part: int = 0, parts: int = 1) -> None:
        self.least, self.order, self.states, self.part, self.parts = least, order, states, part, parts

    def of(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Ordered terms of records of n terms each; for shards of one term, of two and so on, the
        places of the last shared term and the shards. The last of them are not judged yet."""
        doc = np.repeat(np.arange(len(n)), n)
        terms = terms[np.lexsort((terms, self.order[terms >> _SHIFT], doc))]
        first = np.cumsum(n) - n
        reach = n - np.ceil(self.least * n - _EPS).astype(np.int64) + 1
        at = _ranges(first, reach)
        if self.parts > 1:
            at = at[_mix(terms[at]) % np.uint64(self.parts) == self.part]
        shard, out = terms[at], []
        for depth, state in enumerate(self.states, 1):
            judged = state[shard >> _SHIFT]
            out.append((at[judged == 1], shard[judged == 1]))
            large = judged == 2
            at, shard = at[large], shard[large]
            count = (first + reach)[doc[at]] + depth - (at + 1)
            last = np.repeat(shard, count)
            at = _ranges(at + 1, count)
            with np.errstate(over="ignore"):
                shard = _mix(last * np.uint64(0x9E3779B97F4A7C15) + terms[at])
        return terms, [*out, (at, shard)]

    def rows(self, key: np.ndarray, terms: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        terms, placed = self.of(terms, n)
        doc = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        bucket = _mix(terms) & np.uint64(BITS - 1)
        bits = np.zeros((len(terms) + 1, BITS // 64), np.uint64)
        bits[np.arange(1, len(terms) + 1), (bucket >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (bucket & np.uint64(63))
        np.bitwise_xor.accumulate(bits, axis=0, out=bits)
        for depth, (at, shard) in enumerate(placed[: len(self.states)], 1):
            body = np.empty(len(at), _BODY)
            d = doc[at]
            body["key"], body["n"], body["front"] = key[d], n[d], at - first[d] - (depth - 1)
            body["bits"] = bits[(first + n)[d]] ^ bits[at + 1]
            for lo in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(shard[lo : lo + 50_000].view(np.int64)), _packed(body[lo : lo + 50_000])], names=["shard", "body"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (key, terms) as keys, all terms and the number of terms of each record."""
    for batch in batches:
        for at in range(0, batch.num_rows, RECORDS):
            part = batch.slice(at, RECORDS)
            lists = part.column(1)
            terms = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield part.column(0).to_numpy(zero_copy_only=False), terms, np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _counts(hashes: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How many hashes fall to each counter."""
    total, held, count = np.zeros(1 << COUNTERS, np.int64), [], 0

    def add() -> None:
        np.add(total, np.bincount(np.concatenate(held), minlength=1 << COUNTERS), out=total)
        held.clear()

    for h in hashes:
        held.append((h >> _SHIFT).astype(np.int64))
        count += len(h)
        if count > 2_000_000:
            add()
            count = 0
    if held:
        add()
    some = np.flatnonzero(total)
    for lo in range(0, len(some), 100_000):
        c = some[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(total[c])], names=["c", "n"])


def _counted(sets: DataFrame, hashes: Callable) -> np.ndarray:
    """The counters of a whole collection: a table of a fixed size, added up before and after the shuffle."""
    some = sets.select("key", "terms").mapInArrow(lambda batches: _counts(hashes(*x) for x in _parts(batches)), "c int, n bigint")
    got = some.groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTERS, np.int64)
    out[got["c"].to_numpy()] = got["n"].to_numpy()
    return out


class _Search:
    """Consumes rows sorted by shard; yields candidate pairs, or rows of shards too large."""

    def __init__(self, least: float, limit: int) -> None:
        self.least, self.limit = least, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        handed = None  # a shard known to be too large, whose rows are handed on as they come
        for batch in batches:
            column = batch.column(1)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            body = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(_BODY) if len(column) else np.zeros(0, _BODY)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), body))
            count += batch.num_rows
            if count >= HELD:
                rows = [np.concatenate(x) for x in zip(*held)]
                if handed is not None:
                    other = np.flatnonzero(rows[0] != handed)
                    same = int(other[0]) if len(other) else len(rows[0])
                    yield from self._hand_on([x[:same] for x in rows])
                    rows = [x[same:] for x in rows]
                    handed = None if len(other) else handed
                new = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
                cut = int(new[-1]) if len(new) else 0  # the last run may go on in the next batch
                if cut:
                    yield from self._runs([x[:cut] for x in rows])
                    rows = [x[cut:] for x in rows]
                elif len(rows[0]) > self.limit:
                    yield from self._hand_on(rows)
                    handed, rows = rows[0][0], [x[:0] for x in rows]
                held, count = [tuple(rows)], len(rows[0])
        if count:
            rows = [np.concatenate(x) for x in zip(*held)]
            if handed is not None:
                same = rows[0] == handed
                yield from self._hand_on([x[same] for x in rows])
                rows = [x[~same] for x in rows]
            if len(rows[0]):
                yield from self._runs(rows)

    @staticmethod
    def _hand_on(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shard, body = rows
        for lo in range(0, len(shard), 20_000):
            part = slice(lo, min(lo + 20_000, len(shard)))
            m = part.stop - part.start
            yield pa.record_batch([pa.array(np.ones(m, np.int8)), pa.array(shard[part]), pa.array(body["key"][part]), pa.nulls(m, pa.int64()), _packed(body[part])], schema=_OUT)

    def _runs(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shard, body = rows
        start = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1])
        length = np.diff(np.concatenate([start, [len(shard)]]))
        for s, k in zip(start[length > self.limit].tolist(), length[length > self.limit].tolist()):
            yield from self._hand_on([x[s : s + k] for x in rows])
        use = (length > 1) & (length <= self.limit)
        if not use.any():
            return
        body = body[_ranges(start[use], length[use])]
        key = np.ascontiguousarray(body["key"])
        i, j = VantageForest(length[use], np.ascontiguousarray(body["bits"]), body["n"].astype(np.int64), body["front"].astype(np.int64), self.least).pairs()
        a, b = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
        one = np.unique(np.stack([a, b], axis=1)[a < b], axis=0)
        m = len(one)
        if m:
            yield pa.record_batch([pa.array(np.zeros(m, np.int8)), pa.nulls(m, pa.int64()), pa.array(one[:, 0]), pa.array(one[:, 1]), pa.nulls(m, pa.binary())], schema=_OUT)


def _sets(batches: Iterator[pa.RecordBatch], fewest: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) as keys, digests of the set of terms, and its hashes in ascending order."""
    known: dict[str, int] = {}
    for batch in batches:
        keys, digests, terms, ends = [], [], [], [0]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(TERM.findall(text.lower()))
            if len(words) < fewest:
                continue
            if len(known) > 500_000:
                known.clear()
            for w in words.difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            hashes.sort()
            keys.append(key)
            digests.append(hashlib.blake2b(hashes, digest_size=16).digest())
            terms.append(hashes)
            ends.append(ends[-1] + len(hashes))
        if keys:
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(terms).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], names=["key", "d1", "d2", "terms"])


def _split(table: DataFrame, column: str, parts: int) -> list[DataFrame]:
    """The table in so many parts, rows of the same value being in the same one."""
    return [table] if parts == 1 else [table.where(F.pmod(F.xxhash64(column), F.lit(parts)) == i) for i in range(parts)]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class SimilarSets:
    """The similar records of a collection; ``members`` and ``links`` are written tables.

    ``members``: (key, set_id), the id of a set of terms being the smallest key that has it. Rows
    with fewer than ``fewest`` distinct terms belong to none. ``links``: (a, b, similarity) for every
    two different sets with a Jaccard similarity of at least ``least``. Copies therefore cost one row
    each, however many there are. Null columns count as empty text; an empty table gives no rows;
    keys must be 64-bit numbers; a repeated key is taken once, with the text of the smallest digest.
    """

    def __init__(self, df: DataFrame, key: str, columns: list[str], fewest: int = 20, least: float = 0.6) -> None:
        texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), joined_text(*columns).alias("text"))
        rows = written(texts.mapInArrow(lambda batches: _sets(batches, fewest), _SETS_DDL), "term-sets")
        keyed = rows.groupBy("key").agg(F.min(F.struct("d1", "d2")).alias("d")).select("key", "d.d1", "d.d2")
        # as a table its size is known: small, it is broadcast and no terms are shuffled; large, it is not
        first = written(keyed.groupBy("d1", "d2").agg(F.min("key").alias("set_id")), "first-keys")
        self.members = written(keyed.join(first, ["d1", "d2"]).select("key", "set_id"), "members")
        passes = min(OWNERS, -(-stored(rows) // PASS) or 1)
        tables = []
        for one, ids in zip(_split(rows, "key", passes), _split(first, "set_id", passes)):
            own = (one.key == ids.set_id) & (one.d1 == ids.d1) & (one.d2 == ids.d2)
            tables.append(written(one.join(ids, own, "left_semi").select("key", "terms"), "sets"))
        discard(rows, first)
        sets, most = _union(tables), max(PASS, sum(map(stored, tables)))
        found = self._found(sets, fewest, least, most)
        candidates = written(self._searched(_union(found), least), "candidates")
        discard(*found)
        # a pair takes the terms of both its sets along
        passes = min(OWNERS, -(-candidates.count() * ROW * 32 // most) or 1)
        links = []
        for some in _split(candidates, "a", passes):
            ends = written(some.select(F.col("a").alias("key")).union(some.select("b")).distinct(), "ends")
            links.append(written(self._verified(sets.join(ends, "key", "left_semi"), some, least), "links"))
            discard(ends)
        self.links = _union(links)
        discard(*tables, candidates)

    @staticmethod
    def _found(sets: DataFrame, fewest: int, least: float, most: int) -> list[DataFrame]:
        """What the trees find, a table for each pass over some of the shards."""
        sc = sets.sparkSession.sparkContext
        often = _counted(sets, lambda key, terms, n: terms)
        order = np.minimum(8 * np.log2(np.maximum(often, 1)), 255).astype(np.uint8)
        states: list[np.ndarray] = []
        total = 0
        # similar records share so many terms at least, so shards of no more than these hold them
        for depth in range(1, max(1, min(TERMS, int(np.ceil(least * fewest - _EPS)))) + 1):
            sent = sc.broadcast(Shards(least, order, states))
            held = _counted(sets, lambda key, terms, n, sent=sent: sent.value.of(terms, n)[1][-1][1])
            states = [*states, (held > 1).astype(np.uint8) + (held > SHARD)]
            total += int(held[states[-1] == 1].sum())
            if not (held > SHARD).any():
                break
        else:
            total += int(held[states[-1] == 2].sum())
            states[-1] = np.minimum(states[-1], 1)  # no further term: these are split into blocks
        out, passes = [], -(-total * ROW // most) or 1
        for part in range(passes):
            sent = sc.broadcast(Shards(least, order, states, part, passes))
            rows = sets.mapInArrow(lambda batches, sent=sent: (b for x in _parts(batches) for b in sent.value.rows(*x)), _ROWS_DDL)
            out.append(written(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_Search(least, SHARD), _OUT_DDL), "found"))
            sent.unpersist()
        return out

    @staticmethod
    def _searched(found: DataFrame, least: float) -> DataFrame:
        """The pairs found, and those of the shards handed on, which are searched in pairs of blocks."""
        pairs = found.where(F.col("kind") == 0).select("a", "b")
        large = found.where(F.col("kind") == 1).select("shard", F.col("a").alias("key"), "body")
        parts = large.groupBy("shard").agg(F.ceil(F.count("key") / F.lit(SHARD)).cast("int").alias("m"))
        block = F.pmod(F.xxhash64("key"), F.col("m")).cast("int")
        split = large.join(parts, "shard").withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        split = split.select(F.xxhash64("shard", F.least("i", "j"), F.greatest("i", "j")).alias("shard"), "body")
        more = split.repartition("shard").sortWithinPartitions("shard").mapInArrow(_Search(least, 1 << 30), _OUT_DDL)
        return pairs.unionByName(more.select("a", "b")).distinct()

    @staticmethod
    def _verified(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
        one = pairs.join(sets.select(F.col("key").alias("a"), F.col("terms").alias("ta")), "a")
        two = one.join(sets.select(F.col("key").alias("b"), F.col("terms").alias("tb")), "b")
        shared = F.size(F.array_intersect("ta", "tb"))
        ratio = two.select("a", "b", (F.size("ta") + F.size("tb")).alias("total"), shared.alias("shared"))
        return ratio.select("a", "b", (F.col("shared") / (F.col("total") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= least).distinct()

    def pairs(self) -> DataFrame:
        """(a, b), a < b, of all similar rows: copies of one set, and rows of linked sets."""
        m = self.members
        x, y = m.select(F.col("key").alias("p"), F.col("set_id").alias("a")), m.select(F.col("key").alias("q"), F.col("set_id").alias("b"))
        copies = x.join(y, (F.col("a") == F.col("b")) & (F.col("p") < F.col("q"))).select("p", "q")
        linked = self.links.select("a", "b").join(x, "a").join(y, "b").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
        return copies.unionByName(linked).select(F.col("p").alias("a"), F.col("q").alias("b"))

    def groups(self) -> DataFrame:
        """(key, set_id, group_id, links) of every row: its class, the smallest key of all it is
        linked to, directly or through others, and the number of different sets linked to its own."""
        parts = connected_components(self.links, "a", "b").select(F.col("node").alias("set_id"), F.col("component").alias("group_id"))
        degree = self.links.select(F.col("a").alias("set_id")).union(self.links.select("b")).groupBy("set_id").agg(F.count(F.lit(1)).alias("links"))
        out = self.members.join(parts, "set_id", "left").join(degree, "set_id", "left")
        return out.select("key", "set_id", F.coalesce("group_id", "set_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
