"""Hashes of words and runs of words over whole arrays: many texts at once, without a loop over words."""

from __future__ import annotations

from functools import cache

BLOCK = 1 << 18
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@cache
def byte_values():
    """A random-looking odd number for each byte; letters A-Z as a-z, white space zero."""
    import numpy as np

    out = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64), 5) | np.uint64(1)
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


def word_hashes(text: bytes) -> tuple:
    """(hash, first byte) of each word (split at ASCII white space, lower case), from prefix sums over the bytes."""
    import numpy as np

    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and text[end - 1] not in b" \t\n\r\x0b\x0c":  # blocks end with white space
            end += 1
        values = byte_values()[np.frombuffer(text[at:end], np.uint8)]
        edges = np.flatnonzero(np.diff(values != 0, prepend=False, append=False))
        begin, stop = edges[::2], edges[1::2]
        hashes.append(mixed(Segments(values)(begin, stop - begin), 9))
        begins.append(begin + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begins)


def mixed(h, salt: int):
    import numpy as np

    out = (h ^ np.uint64(salt)) * np.uint64(MIX[0])
    out = (out ^ (out >> np.uint64(32))) * np.uint64(MIX[3])
    return out ^ (out >> np.uint64(29))


@cache
def powers_of(n: int) -> tuple:
    """Powers 0 to n of an odd number and of its inverse, modulo 2 ** 64."""
    import numpy as np

    r, out = MIX[0] | 1, []
    for x in (r, pow(r, -1, 1 << 64)):
        row = np.full(n + 1, x, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row))
    return tuple(out)


class Segments:
    """Hashes of runs of values (bytes, words), of any length, from prefix sums."""

    def __init__(self, h) -> None:
        import numpy as np

        powers, self.inverse = powers_of(1 << max(12, len(h).bit_length()))
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers[: len(h)], out=self.sums[1:])

    def __call__(self, at, size):
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]
