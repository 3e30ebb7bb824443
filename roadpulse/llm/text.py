"""Word and span arithmetic over the UTF-8 bytes of many texts at once.

The texts of an Arrow batch are cut into blocks of a bounded size. Within a block every step is one numpy
operation over all its bytes, words or lines. A single longer text is a block of its own.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Block:
    """Texts ``first`` to ``first + len(offsets) - 1`` of a batch, end to end; text i is data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of the byte marks are set in each text."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in order; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = ends[first : last + 1]
        yield Block(first, every[own[0] : own[-1]], own - own[0])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            have = np.multiply.accumulate(steps)
        if n <= 2 * BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


class SpanHash:
    """64-bit hashes of any byte spans of ``data``: equal bytes, equal hash, wherever they lie."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            terms = (data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n)
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self._down = _power("down", pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            plain = (self._sums[ends] - self._sums[starts]) * self._down[starts]
            return mix(plain + (ends - starts).astype(np.uint64) * _STEP)


def runs(marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set marks, cut at the borders of texts."""
    if not len(marks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(marks) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], marks[:-1]]) & ~border[:-1]
    after = np.concatenate([marks[1:], [False]]) & ~border[1:]
    return np.flatnonzero(marks & ~before), np.flatnonzero(marks & ~after) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each span lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def windows(owner: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` consecutive items lie in one text."""
    n = len(owner) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(owner[:n] == owner[size - 1 :])


def gram_hash(items: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive item hashes from each position in ``at``."""
    with np.errstate(over="ignore"):
        total = np.full(len(at), size, np.uint64)
        for j in range(size):
            total = total * np.uint64(_BASE) + items[at + j]
    return mix(total)


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Marks of the items that lie in a span of ``size`` items starting at one of ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:n]) > 0
