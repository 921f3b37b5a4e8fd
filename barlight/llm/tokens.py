"""Byte-level BPE encoding by a lazily determinised transducer, and its streaming decoder.

Encoding a piece left to right, the last token of the encoding of each prefix is unique: it is the
token t ending there whose predecessor p, itself the last token before t, stays apart from t when
the merges run over both. A start position matters only while the bytes since it still begin some
token, so what the transducer must remember is short. Its state is the bytes not yet settled and the
last settled token; a transition reads one byte and emits the tokens that all possible
continuations agree on, at most one longest token later. States and transitions are made when first
met and kept for the life of the worker.
"""

from __future__ import annotations

import base64
import codecs
import gc
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Parameter: where the public vocabulary lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how text is cut into pieces; merges never cross a cut.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Transitions, and pieces and words each, kept by a worker; beyond, a table starts anew, which changes no result.
KEPT, PIECES_KEPT = 200_000, 250_000
#: Characters from which a text's pieces are taken one by one.
LONG = 1_000_000
#: Above every rank.
NEVER = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encoder of one vocabulary (bytes of a token -> rank, lower ranks merging first)."""

    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._spell(ranks)
        self.cut = regex.compile(pieces)
        self.apart_memo: dict[int, bool] = {}
        self.whole_memo: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, tuple[int, ...]] = {}
        # the tokens of a space and a word; with these patterns every single space begins a piece
        self.words: dict[str, tuple[int, ...]] | None = {} if pieces == PIECES else None
        self._reset()

    def _spell(self, ranks: dict[bytes, int]) -> None:
        """All prefixes of tokens as numbered nodes: node and byte -> node; the token a node spells, or
        -1; whether a longer token goes on from it."""
        self.next, self.token, self.more = {}, [-1], bytearray(b"\1")
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.more[node] = 1
                node = self.next.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.more.append(0)
            self.token[node] = rank

    def _reset(self) -> None:
        # state and byte -> next state and settled tokens; per state the tokens to flush if the piece ends, the
        # last settled token, and for every start that may go on its node and the tokens before it
        self.jumps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.flush: list[tuple[int, ...]] = []
        self.made: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = []
        self.number: dict[tuple, int] = {}
        if len(self.apart_memo) > 4 * KEPT:
            self.apart_memo.clear()
        self._state((-1, ((0, ()),)), ())

    def _state(self, what: tuple, flush: tuple[int, ...]) -> int:
        n = self.number.setdefault(what, len(self.made))
        if n == len(self.made):
            self.made.append(what)
            self.flush.append(flush)
        return n

    def merged(self, data: bytes, below: int = NEVER) -> list[bytes]:
        """Parts left when all merges of a rank under ``below`` have run, one by one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts that stand at an edge of a token while it is being merged: (bytes, rank at which
        the part comes to be, rank at which it is merged into the next)."""
        edge = self.edges[right].get(token)
        if edge is None:
            edge, part, end = [], self.bytes_of[token], NEVER
            while True:
                rank = self.ranks[part]
                if len(part) == 1:
                    edge.append((part, -1, end))
                    break
                edge.append((part, rank, end))
                part, end = self.merged(part, rank)[-1 if right else 0], rank
            self.edges[right][token] = edge
        return edge

    def _follows(self, last: int, token: int) -> bool:
        """Whether ``token`` can come after ``last`` (-1: first of its piece).

        Ranks only grow while merging. The two stay apart unless some part at the right edge of the
        one and some part at the left edge of the other exist together when the rank of their
        merger comes up; of equal ranks the leftmost runs first.
        """
        if last < 0:
            ok = self.whole_memo.get(token)
            if ok is None:
                ok = self.whole_memo[token] = len(self.merged(self.bytes_of[token])) == 1
            return ok
        pair = last << 32 | token
        ok = self.apart_memo.get(pair)
        if ok is None:
            get = self.ranks.get
            ok = True
            for x, x_from, x_to in self._edge(last, True):
                for y, y_from, y_to in self._edge(token, False):
                    rank = get(x + y)
                    if rank is not None and x_from < rank < x_to and y_from < rank <= y_to:
                        ok = False
                        break
                if not ok:
                    break
            self.apart_memo[pair] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of a state on a byte."""
        last, live = self.made[state]
        step, tokens, more, apart, new, kept, shortest = self.next.get, self.token, self.more, self.apart_memo.get, None, [], NEVER
        for node, chain in live:
            node = step(node << 8 | byte)
            if node is None:
                continue
            if new is None and (token := tokens[node]) >= 0:
                before = chain[-1] if chain else last
                ok = apart(before << 32 | token)
                if ok or (ok is None and self._follows(before, token)):
                    new = (*chain, token)
            if more[node]:
                kept.append((node, chain))
                if len(chain) < shortest:
                    shortest = len(chain)
        if new is None:
            raise ValueError("the vocabulary lacks a single byte")
        out = ()
        if not kept:  # nothing that began before can go on: all is settled
            out, new, what = new, (), (new[-1], ((0, ()),))
        else:
            kept.append((0, new))
            settled = 0
            while settled < shortest:
                token = new[settled]
                for _, chain in kept:
                    if chain[settled] != token:
                        break
                else:
                    settled += 1
                    continue
                break
            if settled:
                out, new, last = new[:settled], new[settled:], new[settled - 1]
                kept = [(node, chain[settled:]) for node, chain in kept]
            what = (last, tuple(kept))
        move = self.jumps[state << 8 | byte] = (self._state(what, new), out)
        return move

    def piece(self, data: bytes) -> tuple[int, ...]:
        state, out, jumps = 0, [], self.jumps
        for byte in data:
            move = jumps.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return (*out, *self.flush[state])

    def _pieces(self, text: str, ids: list[int]) -> list[int]:
        known = self.known
        # a list of all pieces is faster than one match at a time, unless it would be long
        pieces = self.cut.findall(text) if len(text) < LONG else (m.group() for m in self.cut.finditer(text))
        for piece in pieces:
            got = known.get(piece)
            if got is None:
                got = self.piece(piece.encode("utf-8"))
                if len(piece) <= 40:
                    known[piece] = got
            ids += got
        return ids

    def encode(self, text: str) -> list[int]:
        words = text.split(" ") if self.words is not None and len(text) < LONG else [""]
        if "" in words or len(text.split()) != len(words):  # spaces in a row, or other white space
            ids = self._pieces(text, [])
        else:
            ids, known = self._pieces(words[0], []), self.words
            del words[0]
            for word in words:
                got = known.get(word)
                if got is None:
                    got = tuple(self._pieces(" " + word, []))
                    if len(word) <= 40:
                        known[word] = got
                ids += got
            if len(known) > PIECES_KEPT:
                known.clear()
        if len(self.jumps) > KEPT:
            self._reset()
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        return ids


class StreamingDecoder:
    """Ids to text, a few at a time: bytes of a character that is not complete wait for the rest."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.machine.decode(self.bytes_of[i]) for i in ids)

    def end(self) -> str:
        """What is left; an incomplete character becomes the replacement mark."""
        return self.machine.decode(b"", final=True)


_WORKER: dict[bytes, Transducer] = {}


def _transducer(data: bytes) -> Transducer:
    """One transducer per worker process and vocabulary, so its tables last over tasks."""
    import hashlib

    key = hashlib.sha256(data).digest()
    if key not in _WORKER:
        _WORKER[key] = Transducer(read_ranks(data))
        gc.freeze()  # the vocabulary stays; it need not be looked through
    return _WORKER[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast; below one MB, whatever the collection's size."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) with the token ids of every whole text, without special tokens.

    Null and empty texts give an empty list. Rows are encoded where they are scanned: nothing is
    shuffled, and repeated rows or keys give as many rows.
    """
    vocabulary = _vocabulary(df.sparkSession, path)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(vocabulary.value)
        # the tables are many small objects without cycles: the collector would only walk them
        gc.disable()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    ids = [t.encode(x) if x else [] for x in part.column(1).to_pylist()]
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, ends[-1])
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])
        finally:
            gc.enable()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def decoded(df: DataFrame, key: str, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(key, text) of every list of ids; null lists give empty texts, unknown ids raise."""
    vocabulary = _vocabulary(df.sparkSession, path)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _transducer(vocabulary.value).bytes_of
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                d = StreamingDecoder(bytes_of)
                texts.append(d.feed(row or []) + d.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind.simpleString()}, text string")
