"""Words of Arrow text columns as NumPy arrays: places and 64-bit hashes, no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters of a word, by the bytes of UTF-8; bytes from 128 on are always in words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are taken in pieces of about this many bytes, so that arrays stay small.
PIECE = 4 << 20


@dataclass
class Words:
    data: np.ndarray  # bytes, in lower case if that was asked for
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # of each text the number of its first word, and the number of words

    @property
    def text_of(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text is alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    i = 0
    while i < len(sizes):
        n, j = int(sizes[i]), i + 1
        while j < len(sizes) and n + sizes[j] <= most:
            n += int(sizes[j])
            j += 1
        yield i, j
        i = j


def words_of(texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Words are runs of bytes for which `inside` holds; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    # one more place between texts, so that no word crosses from one to the next
    w = np.zeros(len(data) + 1, dtype=bool)
    np.take(inside, data, out=w[:-1])
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    after[cut - 1] = False
    end = np.flatnonzero(w & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """Finisher of a 64-bit hash: every bit acts on every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Bytes that are hashed at once.
_BLOCK = 1 << 17
#: For 0 to 8 bytes of a word that a lane holds, the bits that count.
_HELD = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_PLACE, _SEED = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03


def hashes(words: Words, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word: its lanes of 8 bytes are mixed with a key of their place and of the seed, and added up.

    A lane's mixture is one to one, so words of up to 8 bytes and equal length never collide, and
    each place has a key of its own, so no regularity of longer words cancels out in the sum.
    Seeds give independent hashes.
    """
    out = np.empty(len(words.start), dtype=np.uint64)
    own = np.uint64((seed + 1) * _SEED % (1 << 64))
    i = 0
    while i < len(out):
        at = int(words.start[i])
        j = max(i + 1, int(np.searchsorted(words.end, at + _BLOCK, "right")))
        past = int(words.end[j - 1])
        data = np.zeros(past - at + 8, dtype=np.uint8)
        data[: past - at] = words.data[at:past]
        eight = np.ndarray(past - at + 1, dtype="<u8", buffer=data, strides=(1,))  # the 8 bytes from each place on
        size = words.end[i:j] - words.start[i:j]
        lanes = (size + 7) >> 3
        first = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        lane = eight[np.repeat(words.start[i:j] - at, lanes) + 8 * place]
        last = first + lanes - 1
        lane[last] &= _HELD[size - 8 * (lanes - 1)]
        key = mix((place + 1).astype(np.uint64) * _PLACE + own)
        out[i:j] = np.add.reduceat(mix(lane ^ key), first) + size.astype(np.uint64)
        i = j
    return mix(out ^ own)


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each word on; len(h) - n + 1 of them, those across texts included."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    step = np.uint64((0x2545F4914F6CDD1D + 2 * seed) % (1 << 64))
    acc = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        acc = acc * step + h[k : k + m]
    return mix(acc)
