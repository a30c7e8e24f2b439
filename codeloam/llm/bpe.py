"""Byte-level BPE with a vectorised pre-tokeniser.

Texts are cut without a regular expression: code points become class symbols by table lookup, a small
automaton over those symbols says where a slice begins, and its run over a whole batch of texts is an
associative scan of transition functions (blocks first compose their own function, the functions are
scanned, then every block replays from its known start state). Slices are deduplicated by Arrow's
dictionary encoding, and only slices that a worker has not met go through pair merging.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The two contraction groups of the published pattern, by length after the apostrophe.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")

# classes of code points
_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE = range(5)
# symbols: the class, with what follows already taken into account; + 8 at the start of a text
_L, _N, _O, _PREFIX, _LAST, _W, _C1, _C2 = range(8)
# states: what the slice under way can still take
_FRESH, _INL, _INN, _INO, _AFTER_SPACE, _INW, _NEED1, _NEED2 = range(8)

#: Code points of a batch that are worked on at once; longer texts are cut at certain boundaries.
CHUNK_CHARS = 1 << 20
#: Slices that a worker remembers.
CACHE_SLICES = 300_000
#: Bytes from which a slice is merged alone, in n log n.
LONG_SLICE = 120
_NO_PAIR = 1 << 40
_BLOCK = 128


def _machine() -> tuple[bytes, bytes]:
    """Next states and cuts, by symbol * 8 + state."""
    go, cut = bytearray(256), bytearray(256)
    for state in range(8):
        for symbol in range(8):
            to, new = {
                _L: (_INL, state not in (_INL, _AFTER_SPACE)),
                _N: (_INN, state not in (_INN, _AFTER_SPACE)),
                _O: (_INO, state not in (_INO, _AFTER_SPACE)),
                _PREFIX: (_AFTER_SPACE, True),
                _LAST: (_FRESH, True),
                _W: (_INW, state != _INW),
                _C1: (_NEED1, True),
                _C2: (_NEED2, True),
            }[symbol]
            if symbol == _L and state in (_NEED1, _NEED2):
                to, new = (_FRESH if state == _NEED1 else _NEED1), False
            if symbol in (_C1, _C2) and state in (_INO, _AFTER_SPACE):
                to, new = _INO, False
            go[symbol * 8 + state], cut[symbol * 8 + state] = to, new
    for symbol in range(8, 16):
        for state in range(8):
            go[symbol * 8 + state], cut[symbol * 8 + state] = go[(symbol - 8) * 8 + _FRESH], 1
    return bytes(go), bytes(cut)


_GO, _CUT = _machine()


def _look(table: bytes, at: np.ndarray) -> np.ndarray:
    """table[at] for bytes; several times as fast as indexing."""
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = _LETTER
        elif kind == "N":
            table[cp] = _NUMBER
        elif kind == "Z":
            table[cp] = _WHITE
    table[[9, 10, 11, 12, 13, 0x85]] = _WHITE
    table[32] = _SPACE
    return table


def symbols(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts; starts: where each non-empty text begins."""
    kind = _classes()[cp]
    n = len(cp)
    first = np.zeros(n + 2, bool)
    first[starts] = True
    first[n:] = True
    white = kind >= _SPACE
    sym = kind.copy()
    sym[white] = _W
    last = white.copy()
    last[:-1] &= ~(white[1:] | first[1:n])
    last[-1:] = False
    last = np.flatnonzero(last)
    sym[last] = np.where(kind[last] == _SPACE, _PREFIX, _LAST)
    at = np.flatnonzero(cp == 39)
    if len(at):
        wide = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = wide[at + 1], wide[at + 2]
        a[first[at + 1]] = 0
        b[first[at + 1] | first[at + 2]] = 0
        sym[at[np.isin(a, [ord(c) for c in CONTRACTIONS_1])]] = _C1
        for x, y in CONTRACTIONS_2:
            sym[at[(a == ord(x)) & (b == ord(y))]] = _C2
    sym[starts] += 8
    return sym


def slice_starts(sym: np.ndarray) -> np.ndarray:
    """Positions where slices begin, by a blocked scan of the automaton's transition functions."""
    n = len(sym)
    blocks = -(-n // _BLOCK)
    rows = np.zeros(blocks * _BLOCK, np.uint8)
    rows[:n] = sym << 3
    rows = np.ascontiguousarray(rows.reshape(blocks, _BLOCK).T)
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)  # f[state, block]: where the block ends from that state
    for row in rows:
        f = _look(_GO, row + f)
    f, span = f.copy(), 1
    while span < blocks:  # inclusive scan: f[:, b] becomes the composition of the blocks up to b
        f[:, span:] = np.take_along_axis(f[:, span:], f[:, :-span].copy(), 0)
        span *= 2
    state = np.concatenate([[np.uint8(_FRESH)], f[_FRESH, :-1]])
    cut = np.empty((_BLOCK, blocks), np.uint8)
    for k, row in enumerate(rows):
        at = row + state
        cut[k] = _look(_CUT, at)
        state = _look(_GO, at)
    return np.flatnonzero(cut.T.ravel()[:n])


class Encoder:
    """Encodes and decodes texts by a rank file (.tiktoken) or by the vocabulary of a tokenizers file (.json).

    With a .json file its added tokens are found in texts, as that library does by default."""

    def __init__(self, path: str):
        self.path, self.added = path, {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
            letters = _byte_letters()
            self.ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        else:
            with open(path, "rb") as f:
                self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = {i: t for t, i in self.ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.top = max(self.vocabulary)
        self._joins = None
        self._forget()
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the id pairs that join to a token, that token's rank, and the ranks of byte pairs."""
        ranks, joins = self.ranks, {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    joins[a << 20 | b] = rank
        keys = np.fromiter(joins, np.int64, len(joins))
        order = np.argsort(keys)
        single = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        keys, values = keys[order], np.fromiter(joins.values(), np.int64, len(joins))[order]
        return keys, values, single, self._rank_of(keys, values, np.repeat(single, 256), np.tile(single, 256))

    @staticmethod
    def _rank_of(keys: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a << 20 | b
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], _NO_PAIR)

    def merge_many(self, slices: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge many slices side by side: in each round every slice joins its pair of lowest rank, the
        leftmost among equals. Yields groups of finished slices: their ids, concatenated, how many each has, and
        which slices they are."""
        if self._joins is None:
            self._joins = self._pairs()
        keys, values, single, of_bytes = self._joins
        raw = np.frombuffer(b"".join(slices), np.uint8)
        tokens = single[raw]
        sizes = np.fromiter(map(len, slices), np.int64, len(slices))
        owner = np.repeat(np.arange(len(slices)), sizes)
        rank = np.full(len(raw), _NO_PAIR, np.int64)
        if len(raw) > 1:
            rank[:-1] = of_bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]]
            rank[:-1][owner[:-1] != owner[1:]] = _NO_PAIR
        while len(tokens):
            edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            length = np.diff(np.append(edge, len(owner)))
            low = np.minimum.reduceat(rank, edge)
            over = low == _NO_PAIR
            if over.any():
                gone = np.repeat(over, length)
                yield tokens[gone], length[over], owner[edge[over]]
                tokens, owner, rank = tokens[~gone], owner[~gone], rank[~gone]
                length, low = length[~over], low[~over]
                if not len(tokens):
                    return
            at = np.flatnonzero(rank == np.repeat(low, length))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            tokens[at] = low
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where they are once the right halves are gone
            tokens, owner, rank = tokens[keep], owner[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(tokens) - 1)
                new = self._rank_of(keys, values, tokens[left], tokens[right])
                rank[left] = np.where((owner[left] == owner[right]) & (right > left), new, _NO_PAIR)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for slices of any length."""
        ranks, n = self.ranks, len(piece)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if left[i] >= 0:
                r = ranks.get(piece[left[i] : stop])
                if r is not None:
                    heapq.heappush(heap, (r, left[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _forget(self) -> None:
        self.cache: dict[bytes, int] = {}  # a slice's place in the three arrays
        self._ids, self._first, self._length = array("I"), array("q"), array("q")

    def _places(self, slices: list[bytes]) -> list[int]:
        if len(self.cache) > CACHE_SLICES:
            self._forget()
        cache = self.cache
        places = list(map(cache.get, slices))
        if None in places:
            missing = [k for k, place in enumerate(places) if place is None]
            short = [k for k in missing if len(slices[k]) <= LONG_SLICE]
            for ids, lengths, which in self.merge_many([slices[k] for k in short]):
                at, before = len(self._first), len(self._ids)
                self._ids.frombytes(ids.astype(np.uint32).tobytes())
                self._first.frombytes((before + np.cumsum(lengths) - lengths).tobytes())
                self._length.frombytes(lengths.astype(np.int64).tobytes())
                own = [short[k] for k in which.tolist()]
                cache.update(zip(map(slices.__getitem__, own), range(at, at + len(own))))
                for k, place in zip(own, range(at, at + len(own))):
                    places[k] = place
            for k in missing:
                if places[k] is None:
                    places[k] = self._keep(slices[k], self._merge_long(slices[k]))
        return places

    def _keep(self, piece: bytes, ids) -> int:
        place = self.cache[piece] = len(self._first)
        self._first.append(len(self._ids))
        self._length.append(len(ids))
        self._ids.extend(ids)
        return place

    def _chunk(self, parts: list[str], only_counts: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Token counts of parts and their ids, concatenated."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        text = "".join(parts)
        if not text:
            return np.zeros(len(parts), np.int64), np.zeros(0, np.uint32)
        data = text.encode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        begin = slice_starts(symbols(cp, (ends - sizes)[sizes > 0]))
        if len(data) == len(cp):
            at = begin
        else:
            width = (cp > 0x7F).view(np.uint8) + (cp > 0x7FF).view(np.uint8) + (cp > 0xFFFF).view(np.uint8)
            at = begin + np.concatenate([[0], np.cumsum(width, dtype=np.int32)])[begin]
        offsets = np.append(at, len(data)).astype(np.int32)
        slices = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which = slices.indices.to_numpy()
        _, cuts, held = slices.dictionary.buffers()
        cuts, held = np.frombuffer(cuts, np.int32)[: len(slices.dictionary) + 1].tolist(), held.to_pybytes()
        place = np.array(self._places([held[i:j] for i, j in zip(cuts, cuts[1:])]), np.int64)
        lengths = np.frombuffer(self._length, np.int64)[place]
        per_slice = lengths[which]
        before = np.concatenate([[0], np.cumsum(per_slice)])
        bounds = before[np.searchsorted(begin, np.concatenate([[0], ends]))]
        if only_counts:
            return np.diff(bounds), None
        first = np.frombuffer(self._first, np.int64)[place]
        flat = np.frombuffer(self._ids, np.uint32)[np.repeat(first[which] - before[:-1], per_slice) + np.arange(before[-1])]
        return np.diff(bounds), flat

    def _parts(self, text: str) -> Iterator[str | int]:
        """Spans of ordinary text of bounded length, and ids of added tokens."""
        at = 0
        for m in self._added.finditer(text) if self._added and "<" in text else ():
            yield from self._cut(text[at : m.start()])
            yield self.added[m.group()]
            at = m.end()
        yield from self._cut(text[at:] if at else text)

    @staticmethod
    def _cut(text: str) -> Iterator[str]:
        """A blank before a visible character always begins a slice, so text can be cut there."""
        while len(text) > CHUNK_CHARS:
            at = CHUNK_CHARS
            while (at := text.rfind(" ", 1, at)) > 0 and text[at + 1].isspace():
                pass
            if at <= 0:
                m = re.compile(r" (?=[^\s])").search(text, CHUNK_CHARS)
                if not m:
                    break
                at = m.start()
            yield text[:at]
            text = text[at:]
        yield text

    def encode_batch(self, texts: list[str], only_counts: bool = False) -> Iterator[tuple[int, np.ndarray | None]]:
        """For each text in order its token count and, unless only_counts, its ids."""
        parts: list[str] = []
        plan: list[tuple[int, int]] = []  # per part: its text, and -1 or the id of an added token
        size = done = 0
        open_ids: list[np.ndarray] = []
        open_n = 0

        def run(last: bool) -> Iterator[tuple[int, np.ndarray | None]]:
            nonlocal parts, plan, size, done, open_ids, open_n
            counts, flat = self._chunk(parts, only_counts)
            where = np.concatenate([[0], np.cumsum(counts)])
            k = 0
            upto = len(texts) if last else plan[-1][0]
            for owner, special in plan:
                while done < owner:
                    yield open_n, None if only_counts else _joined(open_ids)
                    open_ids, open_n, done = [], 0, done + 1
                if special >= 0:
                    open_n += 1
                    if not only_counts:
                        open_ids.append(np.array([special], np.uint32))
                else:
                    open_n += int(counts[k])
                    if not only_counts and counts[k]:
                        open_ids.append(flat[where[k] : where[k + 1]])
                    k += 1
            while done < upto:
                yield open_n, None if only_counts else _joined(open_ids)
                open_ids, open_n, done = [], 0, done + 1
            parts, plan, size = [], [], 0

        for i, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, int):
                    plan.append((i, part))
                    continue
                parts.append(part)
                plan.append((i, -1))
                size += len(part)
                if size >= CHUNK_CHARS:
                    yield from run(False)
        yield from run(True) if texts else ()

    def encode(self, text: str) -> list[int]:
        return next(iter(self.encode_batch([text])))[1].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def offsets(self, ids) -> np.ndarray:
        """Byte offset of every token, and the length of the whole: what decodes any range of ids in place."""
        return np.concatenate([[0], np.cumsum([len(self.vocabulary[int(i)]) for i in ids])]).astype(np.int64)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a .json vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    return Encoder(path)
