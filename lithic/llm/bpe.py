"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Two tokens may stand next to each other in an encoding exactly if merging their joined bytes gives the two back, and
every byte string has exactly one split into tokens whose neighbours all may. So a non-deterministic transducer reads
bytes, guesses where tokens end, and keeps a guess only if the pair it makes may stand. Determinising it on demand
gives states that are sets of (trie node, last token), so equal futures are one state; a guess lives as long as the longest token at most. As the
bytes so far have one split, at most one guess ends a token at each byte: a transition writes that token, and the split of a piece is read off from its end.
States and transitions are made when first needed, kept for the life of a worker process, and dropped together when there are more than
`STATES`; tested pairs and encoded pieces are kept in two generations, of which the older is dropped.

New short pieces of a slice of texts run through the same transducer together, undeterminised: the guesses of all of them are arrays, and each
step reads the next byte of every piece. New pieces would make about as many states as they are, which costs more than stepping their guesses.

`Decoder` turns ids back into bytes piece by piece: a small state machine holds back an unfinished UTF-8 sequence
until its last byte arrives, so what comes out can always be read as text.

Defined results: null and empty texts have no ids; texts of any length are read in one pass; special tokens are
ordinary text; repeated rows are encoded one by one; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import bounded_batches, strings, text_slices

#: Most determinised states that a worker keeps; encoded pieces and tested pairs in each of two generations.
STATES, PIECES, PAIRS = 180_000, 300_000, 200_000
#: A transition is one number: the next state, a free byte (where the next byte read completes the key of the next transition), the token that ends or NONE.
TOKEN_BITS = 24
NONE = (1 << TOKEN_BITS) - 1
#: Pieces of fewer characters are remembered, and stepped together, so many at a time; slots for pairs in front of those kept (a power of two).
SHORT, TOGETHER, SLOTS = 64, 1 << 15, 1 << 20
_MIX, _MIX_EDGE = np.uint64(0x9E3779B97F4A7C15), np.uint32(2654435761)
#: Ids that the decoder joins at once.
CHUNK = 4096


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Edges:
    """The edges of a trie as arrays, looked up many at a time. Keys that share a slot go on to the next, smaller table."""

    def __init__(self, edges: dict[int, int]):
        keys, values = np.fromiter(edges.keys(), np.uint32, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        self.tables = []
        while len(keys):
            bits = max(8, int(4 * len(keys)).bit_length())
            slot = self._slot(keys, bits)
            first = np.unique(slot, return_index=True)[1]
            held, out = np.full(1 << bits, (1 << 32) - 1, np.uint32), np.full(1 << bits, -1, np.int64)
            held[slot[first]], out[slot[first]] = keys[first], values[first]
            self.tables.append((bits, held, out))
            keys, values = np.delete(keys, first), np.delete(values, first)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * _MIX_EDGE * np.uint32(bits | 1)) >> np.uint32(32 - bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 where there is none."""
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for bits, held, out in self.tables:
            slot = self._slot(keys, bits)
            hit = held[slot] == keys
            found[open_[hit]] = out[slot[hit]]
            open_, keys = open_[~hit], keys[~hit]
        return found


class Transducer:
    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.ranks, self.share = ranks, share
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = {i: len(b) for b, i in ranks.items()}
        #: By trie node and byte: the next node (0 if no token goes on there) above the token that ends there or NONE.
        self.edges: dict[int, int] = {}
        nodes = 0
        for word, token in ranks.items():
            at = 0
            for byte in word[:-1]:
                edge = self.edges.get(at << 8 | byte, NONE)
                if edge <= NONE:
                    nodes += 1
                    edge = self.edges[at << 8 | byte] = nodes << TOKEN_BITS | edge
                at = edge >> TOKEN_BITS
            self.edges[at << 8 | word[-1]] = self.edges.get(at << 8 | word[-1], 0) >> TOKEN_BITS << TOKEN_BITS | token
        self.many = Edges(self.edges)
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.sizes[list(self.size_of)] = list(self.size_of.values())
        #: Pairs tested lately, twice the key and whether they may stand; a slot holds one.
        self.tested = np.full(SLOTS, -1, np.int64)
        self.parts_of: dict[int, tuple[int, int] | None] = {}
        self.newer: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        #: A state is a tuple of guesses (trie node above the last token or NONE), oldest first; what they have written is no part of it.
        self.states: list[tuple[int, ...]] = [(NONE,)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives a token; itself twice for a single byte; None if merging its bytes ends elsewhere."""
        known = self.parts_of.get(token, ())
        if known == ():
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            known = (token, token) if len(parts) == 1 else None
            while len(parts) > 1:
                best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == 1 << 60:
                    break
                known = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self.parts_of[token] = known
        return known

    def may_follow(self, last: int, token: int) -> bool:
        """Whether `token` may come right after `last` (-1: at the start).

        The merges on both sides of the border are undone, the latest first (of equal ones the right one). The pair may
        not stand if, at some point, the two parts at the border would have merged before the merge that was undone last.
        """
        right = self.halves(token)
        if right is None:
            return False
        if last < 0:
            return True
        undone, left, ranks, bytes_of, halves = 1 << 60, self.halves(last), self.ranks, self.bytes_of, self.halves
        while True:
            joined = ranks.get(bytes_of[last] + bytes_of[token])
            if joined is not None and joined < undone:
                return False
            if left[0] == last and right[0] == token:
                break
            if right[0] == token or left[0] != last and last > token:
                undone, last = last, left[1]
                left = halves(last)
            else:
                undone, token = token + 1, right[0]
                right = halves(token)
        return True

    def pair(self, last: int, token: int) -> bool:
        """`may_follow`, remembered for the pairs met lately; `last` is NONE at the start."""
        key = last << TOKEN_BITS | token
        known = self.older.get(key)
        if known is None:
            known = self.may_follow(last if last != NONE else -1, token)
        if len(self.newer) >= PAIRS * self.share:
            self.older, self.newer = self.newer, {}
        self.newer[key] = known
        return known

    def pairs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`pair` of many."""
        key = last << TOKEN_BITS | token
        slot = (key.astype(np.uint64) * _MIX >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)
        known = self.tested[slot]
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            once, back = np.unique(key[new], return_inverse=True)
            tested, fits = self.newer.get, []
            for k in once.tolist():
                fit = tested(k)
                fits.append(self.pair(k >> TOKEN_BITS, k & NONE) if fit is None else fit)
            known[new] = 2 * key[new] + np.array(fits, np.int64)[back]
            self.tested[slot[new]] = known[new]
        return known & 1 == 1

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces that are no tokens, the transducer run over all of them side by side."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, stops = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes)
        ends = np.full(len(data), NONE, np.int64)  # by byte, the token that ends there
        # guesses: the piece's end, the byte to read, trie node, last token
        stop = stops[sizes > 0]
        at, node, last = (stops - sizes)[sizes > 0], np.zeros(len(stop), np.int64), np.full(len(stop), NONE)
        while len(at):
            edge = self.many.get((node << 8 | data[at]).astype(np.uint32))
            on = np.flatnonzero(edge >= 0)
            stop, at, last, edge = stop[on], at[on], last[on], edge[on]
            token = edge & NONE
            ended = np.flatnonzero(token != NONE)
            ended = ended[self.pairs(last[ended], token[ended])]
            ends[at[ended]] = token[ended]
            further = at + 1 < stop
            on, ended = np.flatnonzero(further & (edge > NONE)), ended[further[ended]]
            stop, at, node, last = np.r_[stop[on], stop[ended]], np.r_[at[on], at[ended]] + 1, np.r_[edge[on] >> TOKEN_BITS, np.zeros(len(ended), np.int64)], np.r_[last[on], token[ended]]
        # read off from the ends
        owner, at, owners, tokens = np.arange(len(pieces)), stops, [], []
        while True:
            on = np.flatnonzero(at > (stops - sizes)[owner])
            if not len(on):
                break
            owner = owner[on]
            token = ends[at[on] - 1]
            owners.append(owner)
            tokens.append(token)
            at = at[on] - self.sizes[token]
        owner, token = (np.concatenate([np.zeros(0, np.int64), *x[::-1]]) for x in (owners, tokens))
        flat, cuts = token[np.argsort(owner, kind="stable")].tolist(), np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        return [tuple(flat[s:e]) for s, e in zip([0, *cuts], cuts, strict=False)]

    def _ends(self, at: int) -> int:
        """The token that ends with a byte read in a state, both given as a key of `moves`, or NONE."""
        byte, get, tested = at & 0xFF, self.edges.get, self.newer.get
        for guess in self.states[at >> 8]:
            token = get(guess >> TOKEN_BITS << 8 | byte, NONE) & NONE
            if token != NONE:
                last = guess & NONE
                fits = tested(last << TOKEN_BITS | token)
                if self.pair(last, token) if fits is None else fits:
                    return token
        return NONE

    def _move(self, at: int) -> int:
        """The transition from a state by a byte, both given as a key of `moves`."""
        guesses, ended, byte = [], NONE, at & 0xFF
        get, tested = self.edges.get, self.newer.get
        for guess in self.states[at >> 8]:
            edge = get(guess >> TOKEN_BITS << 8 | byte)
            if edge is None:
                continue
            token, last = edge & NONE, guess & NONE
            if token != ended == NONE:
                fits = tested(last << TOKEN_BITS | token)
                if self.pair(last, token) if fits is None else fits:
                    ended = token
            if edge > NONE:
                guesses.append(edge - token | last)
        if ended != NONE:
            guesses.append(ended)
        key = tuple(guesses)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        step = self.moves[at] = to << 8 + TOKEN_BITS | ended
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of text: the token that ends at its last byte, the one that ends where that one starts, and so on."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES * self.share:
            self._forget()
        if not piece:
            return []
        step, known, move = 0, self.moves.get, self._move
        steps = []
        for byte in piece[:-1]:
            at = step >> TOKEN_BITS | byte
            step = known(at) or move(at)
            steps.append(step)
        at = step >> TOKEN_BITS | piece[-1]
        token = known(at, NONE) & NONE
        if token == NONE:  # nothing is read after the last byte, so no state is made for it
            token = self._ends(at)
        back, at, size_of = [token], len(steps) + 1, self.size_of
        while at := at - size_of[token]:
            token = steps[at - 1] & NONE
            back.append(token)
        return back[::-1]


class Decoder:
    """Ids to bytes, of which `feed` returns whole UTF-8 sequences only; `end` returns what is left."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.held = bytes_of, b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a sequence that lacks bytes."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 4 if 0xF0 <= lead <= 0xF4 else 3 if lead >= 0xE0 else 2 if lead >= 0xC2 else 1
                return back if back < need else 0
        return 0

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        data, self.held = self.held, b""
        return data


class Pieces(dict):
    """Ids of pieces; one that is not held is made."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        return self.make(piece)


class Coder:
    """Text to ids and back, with the pieces met lately remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        self.fst, self.split = Transducer(ranks, share), regex.compile(pattern)
        self.written = {i: str(i) for i in ranks.values()}
        self.pieces = PIECES * share
        self.known, self.older = Pieces(self._piece), {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.fst.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) < SHORT:
            self._keep(piece, ids)
        return ids

    def _keep(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.known) >= self.pieces:
            self.older = dict(self.known)
            self.known.clear()
        self.known[piece] = ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split.findall(text))))

    def encode_many(self, texts: Iterable[str]) -> list[list[int]]:
        """`encode` of each text; pieces that are new go through the transducer together."""
        split = [self.split.findall(t) for t in texts]
        new: list[str] = []
        for piece in set(chain.from_iterable(split)).difference(self.known):
            ids = self.older.get(piece)
            if ids is not None:
                self._keep(piece, ids)
            elif len(piece) < SHORT:
                new.append(piece)
        for at in range(0, len(new), TOGETHER):
            coded = {p: c for p in new[at : at + TOGETHER] if (c := p.encode("utf-8", "surrogatepass")) not in self.fst.ranks}
            for piece, ids in zip(coded, self.fst.encode_many(list(coded.values())), strict=True):
                self._keep(piece, ids)
        return [list(chain.from_iterable(map(self.known.__getitem__, own))) for own in split]

    def joined(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.written.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Whole UTF-8 sequences as they become complete."""
        decoder, ids = Decoder(self.fst.bytes_of), list(ids)
        for at in range(0, len(ids), CHUNK):
            yield decoder.feed(ids[at : at + CHUNK])
        yield decoder.end()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.decode_stream(ids))


@contextmanager
def no_cycles() -> Iterator[None]:
    """Nothing in here makes reference cycles, so the collector need not walk the remembered states and pieces again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_coders: dict[tuple[int, str, float], Coder] = {}


def coder(raw: bytes, pattern: str, share: float = 1.0) -> Coder:
    """The coder of a rank file, made once per process; it remembers that share of the states, pairs and pieces above."""
    key = hash(raw), pattern, share
    if key not in _coders:
        _coders[key] = Coder(read_ranks(raw), pattern, share)
    return _coders[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), share: float = 1.0) -> DataFrame:
    """The columns `keep`, and ids, n_tokens, ids_text, decoded: the ids of each text as an array and as joined text, and the bytes they decode to.

    `share` is the part of the memory for states, pairs and pieces that a worker may use; results do not depend on it.
    """
    docs = bounded_batches(docs)
    with open(ranks_path, "rb") as f:  # a vocabulary: its size does not depend on the corpus
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(vocabulary.value, pattern, share)
        for batch in text_slices(batches, limit=1 << 19):
            with no_cycles():
                ids = use.encode_many(strings(batch.column("text")))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, sizes.sum())
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), flat)
            columns = [lists, pa.array(sizes), pa.array(map(use.joined, ids), pa.string()), pa.array(map(use.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, "ids", "n_tokens", "ids_text", "decoded"])

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kept}ids array<int>, n_tokens long, ids_text string, decoded binary")
