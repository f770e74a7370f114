"""Content-defined anchors: in every window of a text the q-gram of least hash, found for whole chunks at once."""

from __future__ import annotations

import numpy as np

from .common import U64, Fingerprints

LOW = U64(0xFFFFFFFF)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """For each start the least of width values, from running minima within blocks of that width, forwards and backwards."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, window: int, q: int, prints: Fingerprints) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, row): each anchor, the first and last start of the windows that choose it, and its row.

    Equal windows choose the same place, since ties go left; windows never cross a row's end.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    n, width = len(data), window - q + 1
    if n < window:
        return none
    at = np.arange(n - q + 1, dtype=np.int64)
    key = (prints.of(at, at + q) & ~LOW) | at.astype(U64)
    start = np.arange(n - window + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(start)]
    fits = start + window <= offs[1:][row]
    start, row = start[fits], row[fits]
    if not len(start):
        return none
    chosen = (sliding_least(key, width)[start] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(start) - 1]])
    return chosen[new], start[new], start[last], row[new]
