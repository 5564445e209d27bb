"""Terms of UTF-8 texts as bytes, cut with one translation table and split(), and runs of integers as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A text is cut into words by so many bytes at once, so that a very long one needs no list of all its words.
CUT_BYTES = 1 << 20
LETTERS = bytes(range(ord("a"), ord("z") + 1))
DIGITS = b"0123456789"
BEYOND_ASCII = bytes(range(128, 256))


def folding(kept: bytes) -> bytes:
    """A table for bytes.translate: kept bytes as they are, A-Z as a-z if those are kept, others as spaces."""
    return bytes(b if b in kept else 32 for b in (ord(chr(i).lower()) if i < 128 else i for i in range(256)))


def term_lists(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about CUT_BYTES each."""
    start, size = 0, len(text)
    while size - start > CUT_BYTES:
        end = start + CUT_BYTES
        part = text[start:end].translate(table)
        last = part.rfind(b" ")
        while last < 0:  # one term is longer than a list
            more = text[end : end + CUT_BYTES].translate(table)
            part, end = part + more, end + len(more)
            last = part.rfind(b" ") if more else len(part)
        yield part[:last].split()
        start += last + 1  # a space, or the end of the text
    yield text[start:].translate(table).split()


def text_column(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, seven bits a byte, the last byte of each below 128."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        size += values >= np.uint64(1 << bits)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        digit = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[end[has] - 1 - k] = digit | np.uint64(128 if k else 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The integers that packed() wrote."""
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128)
    size = np.diff(end, prepend=-1)
    values = np.zeros(len(end), np.uint64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        values[has] |= (raw[end[has] - k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return values
