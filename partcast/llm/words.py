"""Words, their hashes and their shingles, over whole Arrow string columns.

Everything works on UTF-8 bytes: the separators are ASCII, so a byte test and a
character test agree.  Texts are processed in slices of a few megabytes, a text
longer than that on its own, and hashing walks through a slice in windows, so
memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 4 << 20
WINDOW = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything below 0x80 but digits and small letters.
MARKS = np.ones(256, bool)
MARKS[0x80:] = MARKS[0x30:0x3A] = MARKS[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"] = _powers(_BASE, n)
        _POWERS["down"] = _powers(pow(_BASE, -1, 1 << 64), n)
    return _POWERS["up"], _POWERS["down"]


class Words(NamedTuple):
    data: np.ndarray    #: lower-cased bytes
    row: np.ndarray     #: row of each word
    start: np.ndarray   #: first byte of each word
    end: np.ndarray     #: byte after each word
    count: np.ndarray   #: words of each row
    first: np.ndarray   #: index of each row's first word; one more at the end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes of text each."""
    _, at = flat(batch.column(text))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def split(column: pa.Array, separators: np.ndarray) -> Words:
    raw, at = flat(column)
    data = LOWER[raw]
    n, rows = len(data), len(at) - 1
    word = ~separators[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    row = np.searchsorted(at, start, "right") - 1
    count = np.bincount(row, minlength=rows)[:rows]
    return Words(data, row, start, end, count, np.concatenate([[0], np.cumsum(count)]))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(w.start), np.uint64)
    a, n = 0, len(w.start)
    while a < n:
        b = max(a + 1, int(np.searchsorted(w.end, w.start[a] + WINDOW, "right")))
        lo, hi = int(w.start[a]), int(w.end[b - 1])
        up, down = _tables(max(WINDOW, hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LETTER[w.data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = w.start[a:b] - lo, w.end[a:b] - lo
        out[a:b] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out)


def shingles(h: np.ndarray, count: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles and where each row's begin.

    A row of fewer words, but at least one, has its whole sequence as one.
    """
    number = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(int(begin[-1]), np.uint64)
    full = np.repeat(count >= k, number)
    step = np.arange(len(out)) - np.repeat(begin[:-1], number)
    at = (np.repeat(first[:-1], number) + step)[full]
    acc = np.full(len(at), k, np.uint64)
    for j in range(k):
        acc = acc * _U(_BASE) + h[at + j]
    out[full] = acc
    for c in range(1, k):
        rows = np.flatnonzero(count == c)
        acc = np.full(len(rows), c, np.uint64)
        for j in range(c):
            acc = acc * _U(_BASE) + h[first[rows] + j]
        out[begin[rows]] = acc
    return mix(out), begin


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of one sequence of word hashes, none if it is shorter."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = acc * _U(_BASE) + h[j: len(h) - k + 1 + j]
    return mix(acc)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k word hashes, from running sums: for long runs."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _tables(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1] + _U(k))


def set_hash(members: np.ndarray) -> int:
    """Order-free 64-bit hash of a set of hashes, signed."""
    if not len(members):
        return 0
    total = np.add.reduce(mix(members ^ _U(_BASE))) + _U(len(members))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column from flat values and list lengths."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(values)))
