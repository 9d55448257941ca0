"""Elias-Fano sequences and an n-gram trie made of them, as flat arrays that are mapped, not parsed.

A non-decreasing sequence of n numbers below u keeps the low bits of each
number packed, and its high parts in unary: number i with high part h sets bit
h + i.  Ones and zeros are counted per 512 bits, so that the place of any one
(access) or zero (where a high part begins) takes one search in a small
directory and a scan of eight words, for a million queries at a time.

Trie levels: 1 has the words (64-bit hashes) and running sums of their counts;
level k has, below each node of level k - 1, the next word to the left
(a 32-bit mark).  `pointers` say where a node's children begin.  A child is
looked up relative to its context: the sequence holds parent * 2^32 + mark, and
the successor of that number is searched among the parent's children only.
Values are codes into a codebook of 256 means per level.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

_U = np.uint64
_ONES = ~_U(0)
_BLOCK = 512


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one run of bytes: a header, then each array on a multiple of 8 bytes."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    head += b" " * (-(len(head) + 8) % 8)
    out = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        raw = np.ascontiguousarray(a).tobytes()
        out += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


def unpack(data) -> dict[str, np.ndarray]:
    """The arrays of pack, as views of data."""
    at = 8 + int.from_bytes(bytes(data[:8]), "little")
    out = {}
    for name, kind, n in json.loads(bytes(data[8:at])):
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes + -out[name].nbytes % 8
    return out


def mapped(data: bytes) -> mmap.mmap:
    """data in a memory map of its own, outside the interpreter's heap; goes with its last view."""
    out = mmap.mmap(-1, max(1, len(data)))
    out.write(data)
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of a non-decreasing sequence of numbers below universe."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> _U(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
    size = n + int(high[-1] if n else 0) + 2
    bits = np.zeros(size + -size % _BLOCK, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))])
    lows = np.zeros((n * low + 63) // 64 + 1, np.uint64)
    if low:
        part, at = values & _U((1 << low) - 1), np.arange(n) * low
        np.bitwise_or.at(lows, at >> 6, part << (at & 63).astype(np.uint64))
        over = np.flatnonzero((at & 63) + low > 64)
        np.bitwise_or.at(lows, (at[over] >> 6) + 1, part[over] >> (64 - (at[over] & 63)).astype(np.uint64))
    return {"high": words, "ones": ones, "low": lows, "size": np.array([n, low], np.int64)}


class Sequence:
    """Queries on the arrays of `encode`."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        self.high, self.ones, self.low = (arrays[f"{name}.{k}"] for k in ("high", "ones", "low"))
        self.n, self.bits = map(int, arrays[f"{name}.size"])
        self.zeros = np.arange(len(self.ones)) * _BLOCK - self.ones
        self.most = int(self.zeros[-1]) - 1     #: the last zero

    def _select(self, k: np.ndarray, flip: bool) -> np.ndarray:
        """Bit place of one number k, or of zero number k."""
        before = self.zeros if flip else self.ones
        turn = _ONES if flip else _U(0)
        block = np.searchsorted(before, k, "right") - 1
        rest, word = k - before[block], block * (_BLOCK // 64)
        for _ in range(_BLOCK // 64 - 1):
            some = np.bitwise_count(self.high[word] ^ turn)
            go = rest >= some
            rest = rest - some * go
            word = word + go
        now, at = self.high[word] ^ turn, word * 64
        for half in (32, 16, 8, 4, 2, 1):
            some = np.bitwise_count(now & _U((1 << half) - 1))
            go = rest >= some
            rest = rest - some * go
            now = np.where(go, now >> _U(half), now)
            at = at + half * go
        return at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        # a shift by 64 is none: two shifts instead
        out |= (self.low[np.minimum(word + 1, len(self.low) - 1)] << _U(1)) << (_U(63) - shift)
        return out & _U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        return ((self._select(i, False) - i).astype(np.uint64) << _U(self.bits)) | self._lows(i)

    def successor(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of the first number >= each value; begin and end, where given, enclose the answer and the search."""
        high = (values >> _U(self.bits)).astype(np.int64) if self.bits < 64 else np.zeros(len(values), np.int64)
        out, known = np.full(len(values), self.n), high <= self.most
        h = high[known]
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - (h - 1), 0)
        hi = self._select(h, True) - h
        if begin is not None:
            lo, hi = np.maximum(lo, begin[known]), np.minimum(hi, end[known])
        want = values[known] & _U((1 << self.bits) - 1) if self.bits else np.zeros(len(h), np.uint64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        out[known] = lo
        return out

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, -1 where it isn't there."""
        if not self.n or not len(values):
            return np.full(len(values), -1)
        at = self.successor(values, begin, end)
        met = at < (self.n if end is None else end)
        met[met] = self.access(at[met]) == values[met]
        return np.where(met, at, -1)


def codebook(values: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, means) of values; half of the group edges are quantiles, half are evenly spaced, so that rare large
    values lie within a 128th of the range of their mean.  Equal values share a code."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    half = size // 2
    edges = np.unique(np.concatenate([np.sort(values)[np.arange(half) * len(values) // half],
                                      np.linspace(values.min(), values.max(), half, endpoint=False)]))
    edges = edges[np.unique(np.searchsorted(edges, values, "right") - 1)]    # those that hold a value
    code = np.searchsorted(edges, values, "right") - 1
    return code.astype(np.uint8), np.bincount(code, values, len(edges)) / np.bincount(code, minlength=len(edges))


def build(words: np.ndarray, counts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]) -> bytes:
    """A trie's bytes from sorted words with counts, and (parent, mark, values) of each further level, sorted by both."""
    out, above = {}, len(words)

    def put(name: str, values: np.ndarray, universe: int) -> None:
        out.update({f"{name}.{k}": a for k, a in encode(values, universe).items()})

    put("words", words, 1 << 64)
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
    put("counts", total, int(total[-1]) + 1)
    for k, (parent, mark, values) in enumerate(levels, 2):
        put(f"pointers{k}", np.searchsorted(parent, np.arange(above + 1)), len(parent) + 1)
        put(f"marks{k}", (parent.astype(np.uint64) << _U(32)) | mark.astype(np.uint64), max(above, 1) << 32)
        for name, x in values.items():
            out[f"{name}{k}"], out[f"{name}{k}.means"] = codebook(x)
        above = len(parent)
    return pack(out)


class Trie:
    def __init__(self, data) -> None:
        self.arrays = unpack(data)
        self.words, self.counts = Sequence(self.arrays, "words"), Sequence(self.arrays, "counts")
        self.levels = {}
        while f"marks{len(self.levels) + 2}.size" in self.arrays:
            k = len(self.levels) + 2
            self.levels[k] = Sequence(self.arrays, f"pointers{k}"), Sequence(self.arrays, f"marks{k}")

    def word(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, count) of each word; -1 and 0 where it isn't there."""
        node = self.words.find(hashes)
        count, met = np.zeros(len(node), np.int64), np.flatnonzero(node >= 0)
        count[met] = (self.counts.access(node[met] + 1) - self.counts.access(node[met])).astype(np.int64)
        return node, count

    def child(self, k: int, parent: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Nodes of level k below parents of level k - 1, -1 where there is none."""
        pointers, marks = self.levels[k]
        out, met = np.full(len(parent), -1), np.flatnonzero(parent >= 0)
        if len(met):
            p = parent[met]
            one, back = np.unique(p, return_inverse=True)
            begin, end = pointers.access(one).astype(np.int64), pointers.access(one + 1).astype(np.int64)
            out[met] = marks.find((p.astype(np.uint64) << _U(32)) | mark[met].astype(np.uint64), begin[back], end[back])
        return out

    def value(self, name: str, k: int, node: np.ndarray) -> np.ndarray:
        """Values of nodes >= 0."""
        return self.arrays[f"{name}{k}.means"][self.arrays[f"{name}{k}"][node]]
