"""Word and shingle hashes of whole Arrow text columns, by array operations on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # bytes that are hashed at a time
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)

#: Value of a byte in a word: 0 for ASCII white space, A-Z as a-z. Bytes of longer UTF-8 characters are as they are.
VALUES = np.arange(1, 257, dtype=np.uint64)
VALUES[65:91] += np.uint64(32)
VALUES[[32, *range(9, 14)]] = 0


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _room(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE)
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                out = np.full(n, np.uint64(base))
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of consecutive texts, and where each text's words begin (one more for the end)."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._room(n)
        value = VALUES[data]
        char = value != 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = char.copy()
        begins[1:] &= ~char[:-1] | edge[1:n]
        stops = char
        stops[:-1] &= ~stops[1:] | edge[1:n]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * self.powers[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        return hashes, np.searchsorted(starts, offsets)

    def texts(self, column: pa.Array):
        """Word hashes of each text of a column, in order; null is empty. Consecutive texts are hashed together."""
        column = column.cast(pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        null = np.asarray(column.is_null())
        at = 0
        while at < len(column):
            upto = at + 1
            while upto < len(column) and bounds[upto + 1] - bounds[at] <= SLICE:
                upto += 1
            if bounds[upto] - bounds[at] > 4 * SLICE:
                yield np.empty(0, np.uint64) if null[at] else self._giant(data[bounds[at]:bounds[upto]])
            else:
                hashes, first = self.words(data[bounds[at]:bounds[upto]], bounds[at:upto + 1] - bounds[at])
                for k in range(upto - at):
                    yield hashes[first[k]:first[k + 1]] if not null[at + k] else hashes[:0]
            at = upto

    def _giant(self, data: np.ndarray) -> np.ndarray:
        """A long text, in slices that end at white space."""
        parts, at = [], 0
        while at < len(data):
            upto = min(len(data), at + SLICE)
            while upto < len(data) and VALUES[data[upto]] != 0:
                upto += 1
            parts.append(self.words(data[at:upto], np.array([0, upto - at]))[0])
            at = upto
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_sets(column: pa.Array, hasher: WordHasher, size: int = 5):
    """Sorted distinct hashes of runs of `size` words of each text; a text of fewer words is one run."""
    for code in hasher.texts(column):
        if not len(code):
            yield code
            continue
        width = min(size, len(code))
        out = np.full(len(code) - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            out = mixed(out + code[k:k + len(out)])
        yield np.unique(out)
