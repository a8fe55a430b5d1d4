"""SuperMinHash signatures in vector form.

Each element of a set walks through a random permutation of the m signature places, step by step;
at step j it offers j + u (u in [0, 1)) to its j-th place. Since all offers of a step are smaller
than those of later steps, a place is settled in the first step that reaches it, and a set is done
once all its places are: large sets stop after a step or two.
"""

from __future__ import annotations

import numpy as np

from postloom.llm.common import mix

_U = np.uint64
#: Elements whose permutations are kept in memory at once.
FEW = 10_000


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, sorted."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def signatures(owner: np.ndarray, h: np.ndarray, rows: int, m: int, seed: int = 0) -> np.ndarray:
    """rows x m 64-bit integers; a row without elements keeps the largest value everywhere. `h` must be distinct within its owner."""
    top = _U(2**64 - 1)
    sig = np.full((rows, m), top, _U)
    flat = sig.ravel()
    past: list[np.ndarray] = []  # the steps' choices of the elements that still walk
    walk: np.ndarray | None = None  # their permutations, once they are few
    for j in range(m):
        if not len(h):
            break
        r = mix(h, seed * 1000 + j)
        k = ((r >> _U(40)) % _U(m - j)).astype(np.int32) + j
        if walk is None and j and len(h) <= FEW:
            walk = np.broadcast_to(np.arange(m, dtype=np.int32), (len(h), m)).copy()
            line = np.arange(len(h))
            for i, was in enumerate(past):
                walk[line, i], walk[line, was] = walk[line, was], walk[line, i].copy()
        if walk is not None:
            line = np.arange(len(h))
            place = walk[line, k]
            walk[line, k] = walk[line, j]
        else:  # follow the place back through the exchanges so far
            place = k
            for i in range(j - 1, -1, -1):
                place = np.where(place == past[i], i, np.where(place == i, past[i], place))
        # offers of a step differ in their fraction only: 54 bits under the step's number
        np.minimum.at(flat, owner * m + place, (_U(j) << _U(54)) | (r & _U((1 << 54) - 1)))
        going = np.zeros(rows, bool)
        who = np.unique(owner) if j else np.arange(rows)
        going[who] = (sig[who] == top).any(axis=1)
        keep = going[owner]
        if not keep.all():
            owner, h, k = owner[keep], h[keep], k[keep]
            past = [x[keep] for x in past]
            if walk is not None:
                walk = walk[keep]
        if walk is None:
            past.append(k)
    return sig


def bands(sig: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit key for each band of `size` places."""
    rows, m = sig.shape
    n = m // size
    out = np.zeros((rows, n), _U)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out * _U(0x9E3779B97F4A7C15) + sig[:, i : n * size : size], i)
        return mix(out + np.arange(n, dtype=_U), 77)
