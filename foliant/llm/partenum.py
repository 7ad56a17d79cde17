"""PartEnum signatures of feature sets (Arasu, Ganti and Kaushik, VLDB 2006), for Jaccard similarity.

Sizes are dealt into windows that overlap by the factor 1/similarity, so any two similar sets meet in one. In
a window, similar sets differ in at most k features. The domain of features is dealt by a hash into n1 groups
of n2 parts; k differences leave a group with at most k2 differing parts, and so a subset of n2 - k2 parts on
which both sets are equal. Each subset of each group gives one signature: a hash of the set's features in it.

Subsets without any feature would be shared by unrelated sets and give no signature. n1 has some groups to
spare for that; a set with so many groups with an empty subset that the spare ones may not do (``sparse``) is
dealt again by another hash. Two similar sets that agree on empty subsets only are both sparse, and meet in a
later round; the last round gives signatures to empty subsets too. So no pair of similar sets is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from foliant.llm.common import MIX, mixed

ROUNDS = 8
STEP = 1.25**2  # from one window's start to the next


@dataclass(frozen=True)
class Window:
    no: int
    low: int
    high: int  # exclusive
    k: int
    n1: int
    n2: int
    k2: int

    @property
    def needed(self) -> int:
        """Groups that two similar sets agree on, at least."""
        return self.n1 - self.k // (self.k2 + 1)


@lru_cache(maxsize=None)
def windows(percent: int, upto: int = 1 << 40) -> tuple[Window, ...]:
    """Windows for sets whose Jaccard similarity is at least ``percent`` / 100."""
    assert 100 / percent <= STEP
    out, start = [], 1.0
    while start < upto:
        first, last = int(np.ceil(start - 1e-9)), int(np.ceil(start * STEP - 1e-9)) - 1
        if last >= first:
            high = last * 100 // percent
            # 100 |A n B| >= percent |A u B| for sizes s + t means (100 + percent) d <= (100 - percent) (s + t)
            k = (100 - percent) * (last + high) // (100 + percent)
            k2, n2 = (1, 3) if k < 48 else (0, 1)
            least = k // (k2 + 1) + 1
            out.append(Window(len(out), first, high + 1, k, least + 1 + least // 7, n2, k2))
        start *= STEP
    return tuple(out)


def signatures(h: np.ndarray, percent: int = 80) -> np.ndarray:
    """Signatures of a set, given the 64-bit hashes of its features (distinct); empty if only equal sets are similar."""
    out, size = [], len(h)
    for w in windows(percent, 1 << 31):
        if w.low > size:
            break
        if size >= w.high or not w.k:
            continue
        for r in range(ROUNDS):
            x = mixed(h + np.uint64((r + 1) * int(MIX) % 2**64))
            parts = w.n1 * w.n2
            at = ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x[order]), dtype=np.uint64)])
            count = np.bincount(at, minlength=parts)
            ends = np.cumsum(count)
            total = (sums[ends] - sums[ends - count]).reshape(w.n1, w.n2)
            count = count.reshape(w.n1, w.n2)
            sparse = np.zeros(w.n1, bool)
            for no, subset in enumerate(combinations(range(w.n2), w.n2 - w.k2)):
                cols = list(subset)
                held = count[:, cols].sum(1) > 0
                sparse |= ~held
                tag = np.uint64((((w.no * ROUNDS + r) << 8) + no) * 0x5851F42D4C957F2D % 2**64) + np.arange(w.n1, dtype=np.uint64)
                # parts keep their place, so that equal sums in other parts differ
                value = mixed(sum((total[:, c] * np.uint64(2 * c + 3) for c in cols), np.zeros(w.n1, np.uint64)) + mixed(tag))
                out.append(value if r == ROUNDS - 1 else value[held])
            if sparse.sum() < w.needed:
                break
    return np.concatenate(out) if out else np.empty(0, np.uint64)
