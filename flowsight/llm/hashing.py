"""64-bit hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no visible pattern."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


#: Keeps the first k of eight bytes.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and the words per text."""
    return word_hashes_and_ends(texts)[:2]


def word_hashes_and_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, words per text, and the last two bytes of each word as a number.

    Words are what ``bytes.split`` gives: runs without space and U+0009 to U+000D. Eight bytes are
    mixed in at a time, for all words that have so many.
    """
    joined = b"\n".join([*texts, bytes(8)])
    data = np.frombuffer(joined, dtype=np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    blank[-8:] = True
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[::2], edges[1::2]
    size = end - start
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=joined, strides=(1,))
    with np.errstate(over="ignore"):
        out = mixed(size.astype(np.uint64) + ODD) * ODD
        out = mixed(out ^ (eights[start] & KEEP[np.minimum(size, 8)]))
        done, at = 8, np.flatnonzero(size > 8)
        while len(at):
            part = eights[start[at] + done] & KEEP[np.minimum(size[at] - done, 8)]
            out[at] = mixed(out[at] * ODD ^ part)
            done += 8
            at = at[size[at] > done]
    lengths = np.array([len(t) for t in texts], dtype=np.int64) + 1
    last = data[end - 1].astype(np.int64) << 8 | np.where(size > 1, data[end - 2], 0)
    return out, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))), last


class Sequence:
    """Prefix sums from which the hash of any run of words follows."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n + 1, ODD, dtype=np.uint64)) if n else np.full(1, ODD)
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(hashes * self.power[:n], out=self.sums[1:])
            # the inverse of ODD modulo 2**64 brings a run back to power one
            self.inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(ODD), -1, 1 << 64)), dtype=np.uint64))

    def runs(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[start + size] - self.sums[start]) * self.inverse[start])
