"""Pairs of similar headlines among the rows of neighbouring time slices, found within a task.

Rows are sent to a few units each, where all pairs are looked at; no candidate pair is shuffled or
written, only pairs that are similar leave a task. So what is moved grows with the rows, however
many headlines follow one pattern. The bounds used to skip pairs never skip a similar one. Where
only groups are asked for, a task joins its similar rows and a row leaves it once at most, however
often a headline recurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barlight.functions.similarity import _ratio

#: What normalised texts consist of; other characters count as one class, which only raises bounds.
SIGNS = " 0123456789abcdefghijklmnopqrstuvwxyz"
_CODE = np.full(256, len(SIGNS), np.uint8)
_CODE[np.frombuffer(SIGNS.encode(), np.uint8)] = np.arange(len(SIGNS))
_KINDS = len(SIGNS) + 1
#: Dimensions of the character bound; texts compared at once with all others; pairs handled at once.
WIDTH, ROWS, STEP = 192, 256, 1 << 19


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _chunks(count: np.ndarray) -> Iterator[slice]:
    """Slices of entries that stand for about ``STEP`` pairs together, or for one entry's."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        yield slice(lo, hi)
        lo = hi


class Lists:
    """Lists of whole numbers of every text, ascending, one after another."""

    def __init__(self, lists: list[list[int]], words: int) -> None:
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = max(words, 1)
        flat = np.array([w for x in lists for w in x], np.int64)
        self.text = np.repeat(np.arange(len(lists)), self.size)
        self.keys = np.sort(self.text * self.words + flat)
        self.flat = self.keys - self.text * self.words

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers the lists of each pair of texts share."""
        out = np.zeros(len(x), np.int64)
        for part in _chunks(self.size[x]):
            p, q = x[part], y[part]
            word = self.flat[_ranges(self.start[p], self.size[p])]
            key = np.repeat(q, self.size[p]) * self.words + word
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[part] = np.bincount(np.repeat(np.arange(len(p)), self.size[p])[self.keys[at] == key], minlength=len(p))
        return out


def longest_common(codes: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts, 64 characters at a time."""
    length = np.array([len(c) for c in codes], np.int64)
    words, out = (length[x] + 63) // 64, np.zeros(len(x), np.int64)
    by = np.lexsort((length[y], words))
    lo = 0
    while lo < len(by):
        w = int(words[by[lo]])
        hi = min(int(np.searchsorted(words[by], w, "right")), lo + max(1, (1 << 14) // max(w, 1)))
        at = by[lo:hi]
        one, left = np.unique(x[at], return_inverse=True)
        masks = np.zeros((len(one), _KINDS + 1, w), np.uint64)  # the last kind pads shorter texts
        for i, t in enumerate(one.tolist()):
            c = codes[t]
            pos = np.arange(len(c))
            np.bitwise_or.at(masks[i], (c, pos >> 6), np.uint64(1) << (pos & 63).astype(np.uint64))
        two, right = np.unique(y[at], return_inverse=True)
        steps = int(length[two].max(initial=0))
        other = np.full((steps, len(two)), _KINDS, np.uint8)
        for i, t in enumerate(two.tolist()):
            other[: length[t], i] = codes[t]
        state = np.full((w, len(at)), ~np.uint64(0))
        for step in range(steps):
            match = masks[left, other[step, right]].T
            carry = np.zeros(len(at), np.uint64)
            for k in range(w):
                v = state[k]
                u = v & match[k]
                total = v + u
                more = total < v
                total += carry
                more |= total < carry
                state[k] = total | (v & ~match[k])
                carry = more.astype(np.uint64)
        out[at] = 64 * w - np.bitwise_count(state).sum(axis=0)
        lo = hi
    return out


class Texts:
    """Distinct normalised texts with their words; ``stop`` is no token, ``block`` no blocking word."""

    def __init__(self, texts: list[str], stop: list[str], block: list[str], sequence: float) -> None:
        self.texts, self.sequence = texts, sequence
        known: dict[str, int] = {}
        skip, dull = frozenset(stop), frozenset(block)
        tokens, blocking = [], []
        for t in texts:
            own = [w for w in dict.fromkeys(t.split(" ")) if len(w) > 1 and w not in skip]
            tokens.append([known.setdefault(w, len(known)) for w in own])
            blocking.append([known[w] for w in own if w not in dull])
        self.tokens, self.blocking = Lists(tokens, len(known)), Lists(blocking, len(known))
        self.codes = [_CODE[np.frombuffer(t.encode("ascii", "replace"), np.uint8)] for t in texts]
        self.length = np.array([len(c) for c in self.codes], np.int64)

    def by_words(self, own: np.ndarray, near: np.ndarray, token: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (own, near) that share one of the rarest words, one of which two texts with a Jaccard
        similarity of ``token`` must share: each leaves out as many as it must share but one."""
        t = self.tokens
        often = np.bincount(t.flat, minlength=t.words)
        order = np.lexsort((t.flat, often[t.flat], t.text))
        take = np.clip(t.size - np.ceil(token * t.size - 1e-9).astype(np.int64) + 1, 0, t.size)
        words = t.flat[order]
        head = lambda of: (np.repeat(of, take[of]), words[_ranges(t.start[of], take[of])])
        x, w = head(own)
        y, v = head(near)
        by = np.argsort(v, kind="stable")
        y, v = y[by], v[by]
        first = np.searchsorted(v, w)
        count = np.searchsorted(v, w, "right") - first
        found = [np.zeros(0, np.int64)]
        for part in _chunks(count):
            p, q = np.repeat(x[part], count[part]), y[_ranges(first[part], count[part])]
            ok = np.minimum(t.size[p], t.size[q]) >= token * np.maximum(t.size[p], t.size[q]) - 1e-9
            found.append(np.unique(p[ok] * len(self.texts) + q[ok]))
        both = np.unique(np.concatenate(found))
        return both // len(self.texts), both % len(self.texts)

    def _levels(self) -> tuple[np.ndarray, np.ndarray]:
        """A bit per character and number of its occurrences, for the most telling of these, and half
        of what a text needs in common with another besides what the bits cannot show."""
        n = len(self.texts)
        text = np.repeat(np.arange(n), self.length)
        flat = np.concatenate(self.codes) if n else np.zeros(0, np.uint8)
        count = np.bincount(text * _KINDS + flat, minlength=n * _KINDS).reshape(n, _KINDS)
        most = min(int(count.max(initial=0)), 64)
        share = (count[:, :, None] >= np.arange(1, most + 1)).mean(axis=0) if n * most * _KINDS < 1 << 24 else np.stack([(count >= i).mean(axis=0) for i in range(1, most + 1)], axis=1)
        kind, level = np.divmod(np.argsort(-(share * (1 - share)).ravel(), kind="stable")[:WIDTH], max(most, 1))
        bits = (count[:, kind] >= level + 1).astype(np.float32)
        # the characters in common without a bit are at most half of both texts' together
        need = (self.sequence * self.length - (self.length - bits.sum(axis=1))) / 2
        return bits, need.astype(np.float32)

    def by_characters(self, own: np.ndarray, near: np.ndarray, seen: tuple[np.ndarray, ...], span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (own, near) whose characters, whatever their order, allow the ratio, and whose times may lie
        within ``span``. ``seen``: earliest and latest time of every text, as own and as near."""
        bits, need = self._levels()
        one = np.ones((len(self.texts), 1), np.float32)
        left, right = np.concatenate([bits, -need[:, None], one], axis=1), np.concatenate([bits, one, -need[:, None]], axis=1)
        own_first, own_last, near_first, near_last = seen
        own = own[np.argsort(own_first[own], kind="stable")]
        for lo in range(0, len(own), ROWS):
            x = own[lo : lo + ROWS]
            y = near[(near_first[near] <= own_last[x].max()) & (near_last[near] >= own_first[x].min() - span)]
            for at in range(0, len(y), 8 * ROWS):
                z = y[at : at + 8 * ROWS]
                # sums of halves and of single precision numbers far below 2 ** 24: off by less than the margin
                hit = np.flatnonzero((left[x] @ right[z].T).ravel() >= -0.01 - 1e-6 * self.length.max())
                yield x[hit // len(z)], z[hit % len(z)]


class Parts:
    """Parts of the rows of a unit; ``first`` has the least row of every row's part."""

    def __init__(self, rows: int) -> None:
        self.first = np.arange(rows)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.first[a], self.first[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.first, np.maximum(a, b), np.minimum(a, b))
            while (self.first != (least := self.first[self.first])).any():
                self.first = least


class Runs:
    """Rows of one text whose times follow each other within ``span``. All rows of a run are linked, and
    two runs of similar texts have rows within ``span`` if there is no more between the runs themselves."""

    def __init__(self, of: np.ndarray, time: np.ndarray, texts: int, span: int) -> None:
        self.span, self.by = span, np.lexsort((time, of))
        text, at = of[self.by], time[self.by]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > span)
        self.run = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        self.row, self.first, self.last = self.by[start], at[start], at[np.append(start[1:], len(at)) - 1]
        self.count = np.bincount(text[start], minlength=texts)
        self.start = np.cumsum(self.count) - self.count

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """Every row with the first of its run."""
        return self.by, self.row[self.run]

    def between(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A row of each of two linked runs of pairs of similar texts."""
        for part in _chunks(self.count[x] * self.count[y]):
            p, q = x[part], y[part]
            one, other = _ranges(self.start[p], self.count[p]), np.repeat(q, self.count[p])
            one, other = np.repeat(one, self.count[other]), _ranges(self.start[other], self.count[other])
            ok = np.maximum(self.first[one], self.first[other]) - np.minimum(self.last[one], self.last[other]) <= self.span
            yield self.row[one[ok]], self.row[other[ok]]


class Search:
    """Consumes rows (s, i, j, role, k, t, n) sorted by unit (s, i, j); yields similar pairs.

    In a unit every own row (role 1 or 3) is compared with every near one (role 2 or 3), of which
    those not later, by time and then by key, and within ``span`` count. ``by`` words, characters or
    both: pairs with a Jaccard similarity of ``token``, and those below it with a ratio of ``sequence``.
    With ``linked``, (a, b) join the same rows as these pairs, one at most for each row of a unit.
    """

    def __init__(self, stop: list[str], block: list[str], sequence: float, token: float, span: int, shared: int, by: tuple[str, ...], linked: bool = False) -> None:
        self.stop, self.block, self.sequence, self.token, self.span, self.least, self.by, self.linked = stop, block, sequence, token, span, max(shared, 1), by, linked

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        unit = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                here = tuple(ids[lo].tolist())
                if held and here != unit:
                    yield from self._unit(pa.Table.from_batches(held))
                    held = []
                unit = here
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from self._unit(pa.Table.from_batches(held))

    def _unit(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        role, time = rows["role"].to_numpy(), rows["t"].to_numpy()
        key = rows["k"].combine_chunks()
        rank = pc.rank(key, tiebreaker="dense").to_numpy()
        coded = rows["n"].combine_chunks().dictionary_encode()
        texts = Texts(coded.dictionary.to_pylist(), self.stop, self.block, self.sequence)
        of = coded.indices.to_numpy().astype(np.int64)
        sides, seen, used = [], [], []
        for bit in (1, 2):
            at = np.flatnonzero(role & bit)
            at = at[np.argsort(of[at], kind="stable")]
            count = np.bincount(of[at], minlength=len(texts.texts))
            first, last = np.full(len(count), np.iinfo(np.int64).max), np.full(len(count), np.iinfo(np.int64).min)
            np.minimum.at(first, of[at], time[at])
            np.maximum.at(last, of[at], time[at])
            sides.append((at, np.cumsum(count) - count, count))
            seen += [first, last]
            used.append(np.flatnonzero(count))
        if not len(used[0]) or not len(used[1]):
            return
        sizes, parts = texts.tokens.size, Parts(len(time))

        def measured(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
            tokens = texts.blocking.shared(x, y)
            ok = tokens >= self.least
            x, y, tokens = x[ok], y[ok], tokens[ok]
            both = texts.tokens.shared(x, y)
            return x, y, tokens, both / (sizes[x] + sizes[y] - both)

        if "words" in self.by and self.token <= 1:
            x, y, tokens, alike = measured(*texts.by_words(*used, self.token))
            ok = alike >= self.token
            if self.linked:
                runs = Runs(of, time, len(texts.texts), self.span)
                parts.join(*runs.within())
                for a, b in runs.between(x[ok], y[ok]):
                    parts.join(a, b)
            else:
                for a, b, p in self._rows(sides, x[ok], y[ok], time, rank):
                    yield self._out(key, a, b, tokens[ok][p], alike[ok][p], pa.nulls(len(a), pa.float64()))
        if "characters" in self.by and self.sequence <= 1:
            for x, y in _gathered(texts.by_characters(*used, tuple(seen), self.span)):
                x, y, tokens, alike = measured(x, y)
                ok = np.flatnonzero(alike < self.token)
                # matching blocks make a common subsequence, so its length bounds the ratio
                most = longest_common(texts.codes, x[ok], y[ok])
                ok = ok[2 * most >= self.sequence * (texts.length[x[ok]] + texts.length[y[ok]]) - 1e-9]
                x, y, tokens, alike = x[ok], y[ok], tokens[ok], alike[ok]
                known: dict[int, float] = {}
                for a, b, p in self._rows(sides, x, y, time, rank):
                    if self.linked:
                        apart = parts.first[a] != parts.first[b]
                        a, b, p = a[apart], b[apart], p[apart]
                    for i in np.unique(p).tolist():
                        if i not in known:
                            known[i] = _ratio(texts.texts[x[i]], texts.texts[y[i]])
                    ratio = np.array([known[i] for i in p.tolist()], float)
                    good = ratio >= self.sequence
                    if self.linked:
                        parts.join(a[good], b[good])
                    else:
                        yield self._out(key, a[good], b[good], tokens[p[good]], alike[p[good]], pa.array(ratio[good]))
        if self.linked:
            a = np.flatnonzero(parts.first != np.arange(len(time)))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(parts.first[a]))], names=["a", "b"])

    def _rows(self, sides: list, x: np.ndarray, y: np.ndarray, time: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of rows of pairs of texts, with the number of the latter."""
        (own, own_start, own_count), (near, near_start, near_count) = sides
        for outer in _chunks(own_count[x]):
            pair = np.repeat(np.arange(len(x))[outer], own_count[x[outer]])
            a = own[_ranges(own_start[x[outer]], own_count[x[outer]])]
            count = near_count[y[pair]]
            for inner in _chunks(count):
                p, i = np.repeat(pair[inner], count[inner]), np.repeat(a[inner], count[inner])
                j = near[_ranges(near_start[y[pair[inner]]], count[inner])]
                gap = time[i] - time[j]
                ok = ((gap > 0) & (gap <= self.span)) | ((gap == 0) & (rank[i] > rank[j]))
                if ok.any():
                    yield i[ok], j[ok], p[ok]

    @staticmethod
    def _out(key: pa.Array, a: np.ndarray, b: np.ndarray, tokens: np.ndarray, alike: np.ndarray, ratio: pa.Array) -> pa.RecordBatch:
        columns = [key.take(pa.array(a)), key.take(pa.array(b)), pa.array(tokens), pa.array(alike), ratio]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "tokens", "jaccard", "ratio"])


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in larger lots."""
    held, count = [], 0
    for x, y in parts:
        held.append((x, y))
        count += len(x)
        if count >= STEP:
            yield tuple(np.concatenate(z) for z in zip(*held))
            held, count = [], 0
    if count:
        yield tuple(np.concatenate(z) for z in zip(*held))
