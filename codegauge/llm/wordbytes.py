"""Words of many texts at once, as hashes, straight from the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 4 << 20  # bytes hashed together
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def _random_words(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 1 << 63, n, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


class ByteWords:
    """Maximal runs of the bytes for which ``letters`` is not negative.

    ``letters`` gives for each of the 256 bytes the byte it counts as (so A may count as a),
    or -1 where it ends a word.
    """

    def __init__(self, letters: np.ndarray) -> None:
        values = _random_words(256)
        self.inside = letters >= 0
        self.value = np.where(self.inside, values[np.maximum(letters, 0)], 0).astype(np.uint64)
        powers = np.empty(CHUNK + 1, np.uint64)
        inverses = np.empty(CHUNK + 1, np.uint64)
        powers[0] = inverses[0] = 1
        powers[1:], inverses[1:] = BASE, INVERSE
        self.powers, self.inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, after one another, and where each text's words end.

        A null text has no words. A text's bytes are read in chunks cut where no word runs on.
        """
        offsets, data = text_bytes(column)
        hashes, at = [], []
        start, end = int(offsets[0]), int(offsets[-1])
        while start < end:
            stop = min(start + CHUNK, end)
            if stop < end:
                stop = self._cut(data, start, stop, offsets)
            h, a = self._hash(data[start:stop], start, offsets)
            hashes.append(h)
            at.append(a)
            start = stop
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(at), offsets[1:], side="left")

    def _cut(self, data: np.ndarray, start: int, stop: int, offsets: np.ndarray) -> int:
        """The last place up to ``stop`` between two words, or the first after it."""
        while stop < len(data) and self.inside[data[stop]] and self.inside[data[stop - 1]]:
            text = int(np.searchsorted(offsets, stop, side="right")) - 1
            if offsets[text] == stop:
                return stop
            free = np.flatnonzero(~self.inside[data[max(start, int(offsets[text])) : stop]])
            if len(free):
                return max(start, int(offsets[text])) + int(free[-1]) + 1
            if offsets[text] > start:
                return int(offsets[text])
            after = np.flatnonzero(~self.inside[data[stop : int(offsets[text + 1])]])
            return stop + int(after[0]) if len(after) else int(offsets[text + 1])
        return stop

    def _hash(self, part: np.ndarray, base: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.inside[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > base) & (offsets < base + len(part))] - base
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        powers, inverses = self.powers, self.inverses
        if len(part) >= len(powers):  # one word longer than a chunk
            steps = np.full(len(part) + 1, BASE, np.uint64)
            steps[0] = 1
            powers = np.multiply.accumulate(steps)
            steps[1:] = INVERSE
            inverses = np.multiply.accumulate(steps)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.value[part] * powers[: len(part)], out=total[1:])
        return mixed((total[b] - total[a]) * inverses[a] + (b - a).astype(np.uint64)), a + base


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a string column's rows and the bytes they point into; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return offsets.astype(np.int64), data


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` words in a row."""
    n = len(hashes) - length + 1
    out = np.full(max(n, 0), length, np.uint64)
    for k in range(length if n > 0 else 0):
        out = (out ^ hashes[k : k + n]) * np.uint64(BASE)
        out ^= out >> np.uint64(29)
    return out
