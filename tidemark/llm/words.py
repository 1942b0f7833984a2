"""Words of many texts at once: byte spans and 64-bit hashes, computed over one Arrow buffer.

A word is a run of bytes other than the six ASCII white-space characters, so multi-byte characters
are never cut. Hashes are sums of random values per byte times powers of an odd number, modulo 2**64, which lets
any run be hashed from two prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_values(seed: int, fold_case: bool = False) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
    if fold_case:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


STRETCH = 1 << 20  # bytes or words hashed at once; a longer text is hashed in stretches, which gives the same


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far.

    That is a stretch and a span: spans are short, but for a word longer than a stretch.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def grow(self, count: int) -> None:
        if count > len(self.up):
            ones = np.full(count, self.base, dtype=U64), np.full(count, self.inverse, dtype=U64)
            for row in ones:
                row[0] = 1
            self.up, self.down = np.cumprod(ones[0]), np.cumprod(ones[1])


BYTES = Powers(0x9E3779B97F4A7C15)
WORDS = Powers(0xD1342543DE82EF95)
WORDS_2 = Powers(0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the borders between them; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    borders = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def word_spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text."""
    word = ~SPACE[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = before[-1] = False
    before[1:] = word
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[borders] = True
    starts = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
    after = np.append(word[1:], False)
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, borders)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash per span of bytes; spans follow one another."""
    out, at = np.empty(len(starts), dtype=U64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, side="right")))
        first, last = int(starts[at]), int(ends[stop - 1])
        s, e = starts[at:stop] - first, ends[at:stop] - first
        BYTES.grow(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=U64)
        np.cumsum(values[data[first:last]] * BYTES.up[: last - first], out=sums[1:])
        out[at:stop] = mixed((sums[e] - sums[s]) * BYTES.down[s] + (e - s).astype(U64))
        at = stop
    return out


def window_hashes(words: np.ndarray, size: int, powers: Powers = WORDS) -> np.ndarray:
    """Hash of every ``size`` consecutive words, by the first one's place; none when there are fewer."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    out = np.empty(count, dtype=U64)
    for at in range(0, count, STRETCH):
        part = words[at : at + STRETCH + size - 1]
        powers.grow(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * powers.up[: len(part)], out=sums[1:])
        own = len(part) - size + 1
        out[at : at + own] = mixed((sums[size:] - sums[:-size]) * powers.down[:own])
    return out
