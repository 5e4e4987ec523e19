"""Hashes of all words of many texts at a time, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that a task turns into words at a time

# bytes of words: A-Z lower-cased, digits, and all bytes of characters beyond ASCII
_FOLD = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32

_BASE = 0x100000001B3
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK * 2, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word of texts that lie one after the other, and each text's first word.

    `starts` are the texts' first bytes. Upper-case Latin-1 letters count as
    lower-case ones. A word never runs from one text into the next.
    """
    b = _FOLD[raw]
    if len(b) > 1:
        accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        b[1:][accented] += 0x20
    inside = b > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[starts < len(b)]
    first[at] = inside[at]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = at[at > 0] - 1
    last[at] = inside[at]
    end = np.flatnonzero(last) + 1
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up[:len(b)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin]), begin, np.searchsorted(begin, starts)


def text_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(raw, np.zeros(1, np.int64))[0] if len(raw) else np.zeros(0, np.uint64)


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, each row's first word) of about CHUNK bytes of text at a time; one long text in parts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[stop])
        if b - a <= 2 * CHUNK:
            words, _, firsts = words_of(data[a:b], offsets[row:stop] - a) if b > a else (np.zeros(0, np.uint64), None, np.zeros(stop - row, np.int64))
        else:  # hashed in parts that end between words
            parts, at = [], a
            while at < b:
                end = min(b, at + CHUNK)
                while end < b and _FOLD[data[end - 1]]:
                    end += 1
                parts.append(words_of(data[at:end], np.zeros(1, np.int64))[0])
                at = end
            words, firsts = np.concatenate(parts), np.zeros(1, np.int64)
        yield row, words, firsts
        row = stop
