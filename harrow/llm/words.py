"""Words of many texts at once: places, lengths and 64-bit hashes, from their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes of words between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
# Bytes of words of ASCII letters, digits and all characters beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_weights = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (one to one)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(n: int) -> np.ndarray:
    """Odd multiplier of each place in a word."""
    global _weights
    if len(_weights) < n:
        _weights = mix(np.arange(1, max(n, 256) * 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _weights


@dataclass
class Words:
    """Words of a list of texts, one after the other."""

    hashes: np.ndarray  # uint64, of the lower-cased word
    of_text: np.ndarray  # first word of each text, and their number at the end
    letters: np.ndarray  # lower-cased bytes of all words without what stands between
    starts: np.ndarray  # first byte of each word in letters, and their number at the end

    def spelled(self, a: int, b: int) -> bytes:
        """Words a to b with one space after each."""
        at = self.starts[a: b + 1].tolist()
        base = at[0]
        letters = self.letters[base: at[-1]].tobytes()
        return b"".join(letters[x - base: y - base] + b" " for x, y in zip(at, at[1:], strict=False))


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Words:
    """``data`` and ``at`` as ``common.text_bytes`` gives them; ``inside``: bytes of words."""
    flags = inside[data]
    places = np.flatnonzero(flags)
    if not len(places):
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))
    new = np.empty(len(places), bool)
    new[0] = True
    np.not_equal(places[1:], places[:-1] + 1, out=new[1:])
    # A text's first byte begins a word even where the text before ends with one.
    first = np.searchsorted(places, at)
    begins = first[:-1][np.diff(first) > 0]
    new[begins] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(places)))
    letters = LOWER[data[places]]
    place = np.arange(len(places)) - np.repeat(starts, lengths)
    values = weights(int(lengths.max()))[place]
    values *= letters + np.uint8(1)
    return Words(mix(np.add.reduceat(values, starts)), np.searchsorted(starts, first), letters, np.append(starts, len(places)))
