"""Dense numeric features of Arrow text batches, by numpy on their bytes or code points."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.words import Words, run_hashes, text_bytes

_all = np.arange(256, dtype=np.uint8)
UPPER = (_all >= 65) & (_all <= 90)
LETTER = UPPER | ((_all >= 97) & (_all <= 122)) | (_all >= 128)
DIGIT = (_all >= 48) & (_all <= 57)
SPACE = np.isin(_all, [32, *range(9, 14)])
PUNCTUATION = (_all > 32) & (_all < 127) & ~LETTER & ~DIGIT
LOWER = np.where(UPPER, _all + 32, _all).astype(np.uint8)
#: Characters written for letters that they resemble: signs, then Cyrillic and Greek letters; fixed values.
SIGNS = ("01345789@$!*|", "oieastbgasiii")
RESEMBLING = ("аеорсухіѕјοαν", "aeopcyxisjoav")


@dataclass(frozen=True)
class Unicode:
    """What each code point is: a letter (\\p{L}), a capital; its lower case; the letter it is read as."""

    letter: np.ndarray
    capital: np.ndarray
    lower: np.ndarray
    read: np.ndarray
    sign: np.ndarray


@functools.cache
def unicode() -> Unicode:
    points = [chr(c) for c in range(0x110000)]
    kinds = np.array([unicodedata.category(c) for c in points])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in points], np.uint32)
    read = lower.copy()
    for c in points:  # accents, full width and other styles of a letter
        if unicodedata.decomposition(c):
            first = unicodedata.normalize("NFKD", c)[0]
            if first.isalpha():
                read[ord(c)] = lower[ord(first)]
    for signs, letters in (SIGNS, RESEMBLING):
        read[[ord(c) for c in signs]] = [ord(c) for c in letters]
    sign = np.zeros(len(points), bool)
    sign[[ord(c) for c in SIGNS[0]]] = True
    return Unicode(np.char.startswith(kinds, "L"), np.isin(kinds, ["Lu", "Lt"]), lower, read, sign)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each row's offsets."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true that stay within their row."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(inside) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(inside) else np.zeros(0, np.int64)
    return start, end


class CodePoints:
    """The code points of a text array; those of row r are offsets[r] to offsets[r + 1]."""

    def __init__(self, text: pa.Array):
        raw, offsets = text_bytes(text)
        self.points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.offsets = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        self.rows = len(offsets) - 1


class LetterWords:
    """Lower-cased runs of letters of a text array; with lookalike, of what is read as letters."""

    def __init__(self, text: CodePoints, lookalike: bool = False):
        known, points, self.offsets = unicode(), text.points, text.offsets
        letter = known.letter[points]
        self.start, self.end = runs(letter | known.sign[points] if lookalike else letter, self.offsets)
        if lookalike:  # a run without a letter is a number or punctuation
            letters = np.concatenate([[0], np.cumsum(letter)])
            held = letters[self.end] > letters[self.start]
            self.start, self.end = self.start[held], self.end[held]
        self.hash = run_hashes((known.read if lookalike else known.lower)[points], self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)


def word_hash(word: str) -> int:
    """The hash that LetterWords gives to this word alone."""
    words = LetterWords(CodePoints(pa.array([word])))
    return int(words.hash[0]) if len(words.hash) == 1 else 0


def shares(words: Words) -> np.ndarray:
    """Columns: log bytes, and the shares of bytes that are upper case among letters, punctuation,
    ! or ?, digits, non-ASCII, spaces, newlines, and in runs of one repeated byte."""
    raw, offsets = words.raw, words.offsets
    n = np.maximum(1, np.diff(offsets)).astype(np.float64)
    letters = np.maximum(1, per_row(LETTER[raw], offsets))
    same = np.zeros(len(raw), bool)
    if len(raw) > 2:
        same[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & ~SPACE[raw[2:]]
    columns = [
        np.log1p(np.diff(offsets)),
        per_row(UPPER[raw], offsets) / letters,
        per_row(PUNCTUATION[raw], offsets) / n,
        per_row((raw == 33) | (raw == 63), offsets) / n,
        per_row(DIGIT[raw], offsets) / n,
        per_row(raw >= 128, offsets) / n,
        per_row(SPACE[raw], offsets) / n,
        per_row(raw == 10, offsets) / n,
        per_row(same, offsets) / n,
    ]
    return np.stack(columns, 1)
