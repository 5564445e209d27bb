"""Word spans and word hashes of Arrow text batches, computed with numpy on the UTF-8 bytes.

Nothing here touches a Python string per word: a batch of texts stays one byte array and words are
(start, end) pairs into it. A word's hash is the sum of its bytes, each times a random number for
its place in the word, modulo 2**64. A sequence of words is hashed by a polynomial of their hashes
modulo the prime 2**61 - 1, so sequences that overlap come from one prefix sum. Both take a key,
and hashes of different keys are independent: two give more than 120 bits. (A polynomial modulo
2**64 would not do: whatever its base, it gives some unlike texts of regular form the same hash.)
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64((1 << 61) - 1)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_3, _29, _32, _61 = (np.uint64(n) for n in (3, 29, 32, 61))
_places: dict[int, np.ndarray] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(n: int, key: int) -> np.ndarray:
    """Random numbers for the first n places of a run."""
    if key not in _places or len(_places[key]) < n:
        _places[key] = mix64(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * ODD + np.uint64(key << 56))
    return _places[key][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64 bits of values[s:e] for each pair; the runs are disjoint and in order."""
    size = ends - starts
    before = np.cumsum(size) - size
    turn = np.arange(int(size.sum())) - np.repeat(before, size)
    sums = np.zeros(len(turn) + 1, np.uint64)
    terms = values[turn + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    np.cumsum(terms * places(int(size.max(initial=0)), key)[turn], out=sums[1:])
    return mix64(sums[before + size] - sums[before] + size.astype(np.uint64) * ODD)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & PRIME) + (x >> _61)
    return np.where(x >= PRIME, x - PRIME, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of residues."""
    a1, a0, b1, b0 = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return reduced((a1 * b1 << _3) + (middle >> _29) + ((middle & _LOW29) << _32) + (low & PRIME) + (low >> _61))


def powers(n: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the key's base and of its inverse modulo the prime."""
    if key not in _powers or len(_powers[key][0]) < n:
        base = int(mix64(np.array([key + 1], np.uint64) * ODD)[0]) % int(PRIME)
        tables = []
        for b in (base, pow(base, -1, int(PRIME))):
            table = np.ones(1, np.uint64)
            while len(table) < max(n, 1 << 12):
                table = np.concatenate([table, product(table, np.uint64(pow(b, len(table), int(PRIME))))])
            tables.append(table)
        _powers[key] = tables[0], tables[1]
    return _powers[key][0][:n], _powers[key][1][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """61 bits of values[s:e] for each pair, mixed; equal ranges have equal hashes wherever they lie."""
    up, down = powers(len(values) + 1, key)
    terms = product(reduced(values), up[:-1])
    high, low = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms >> _32, out=high[1:])
    np.cumsum(terms & _LOW32, out=low[1:])
    sums = reduced((high >> _29) + ((high & _LOW29) << _32) + low)
    lengths = (ends - starts).astype(np.uint64)
    return mix64(product(reduced(sums[ends] + PRIME - sums[starts]), down[starts]) + lengths * ODD)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes of text each."""
    text = batch.column(column)
    if not batch.num_rows:
        return
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0)).astype(np.int64)
    run = np.cumsum(lengths) // limit
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array, and the n + 1 offsets of its rows."""
    text = pa.compute.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a text array: row, start and end of each, in order."""

    def __init__(self, text: pa.Array):
        self.raw, self.offsets = text_bytes(text)
        self.rows = len(self.offsets) - 1
        inside = ~_SEPARATOR[self.raw]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        before[self.offsets] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        #: words of row r are first[r] to first[r + 1]
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self, key: int = 0) -> np.ndarray:
        return run_hashes(self.raw, self.start, self.end, key)

    def grams(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that start an n-gram within their row, and the n-grams' hashes."""
        at = np.arange(len(hashes))
        at = at[at + n <= self.first[self.row + 1]] if len(at) else at
        return at, range_hashes(hashes, at, at + n)
