"""Signature trees over small sets: which sets are linked, by a dual traversal that prunes pairs of nodes.

A set's signature is a bitmap of its members.  A node holds the OR and the AND of its sets' bitmaps and the
range of their sizes.  Of two sets, every bit that only one has stands for a member that the other lacks,
so the overlap is at most size - bits missing; for two nodes the same holds with the AND of one and the OR
of the other.  A pair of nodes whose largest possible overlap is too small is dropped whole, and so is one
whose sets are all connected already.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bits of the smallest and the largest bitmap; between, twice the power of two that is not less than the set.  With
#: half of it, sets of a similarity well under the threshold pass, and more of them the larger the corpus is.
BITS_LEAST, BITS_MOST = 512, 1 << 17
LEAF, FANOUT = 32, 8
#: Unpacked bits that are handled at once.
STEP_BITS = 1 << 23


def width(n: np.ndarray, most: int = BITS_MOST) -> np.ndarray:
    """Bits of the bitmap of a set of n."""
    return np.clip(2 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), BITS_LEAST, most)


def bitmaps(tokens: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps, as rows of unsigned 64-bit words; tokens are hashes, set i has those from offsets[i] to offsets[i + 1]."""
    n = len(offsets) - 1
    out = np.empty((n, bits // 64), np.uint64)
    place = (tokens & np.array(bits - 1, tokens.dtype)).astype(np.int64)
    for lo in range(0, n, max(1, STEP_BITS // bits)):
        hi = min(n, lo + max(1, STEP_BITS // bits))
        part = np.zeros((hi - lo, bits), np.uint8)
        part[np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), place[offsets[lo] : offsets[hi]]] = 1
        out[lo:hi] = np.packbits(part, axis=1, bitorder="little").view(np.uint64)
    return out


def fold(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


class Maps:
    """Bitmaps of several widths; two sets are compared at the smaller width of the two.

    Sets that can be similar differ in width by one power of two at most, which takes a similarity of a half.
    """

    def __init__(self, packed: list[bytes]) -> None:
        self.words = np.fromiter((len(b) // 8 for b in packed), np.int64, len(packed))
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = {int(w): np.flatnonzero(self.words == w) for w in np.unique(self.words)}
        full = {w: np.frombuffer(b"".join([packed[i] for i in at]), np.uint64).reshape(-1, w) for w, at in own.items()}
        for w, at in own.items():
            index = np.full(len(packed), -1)
            index[at] = np.arange(len(at))
            maps = full[w]
            if 2 * w in own:
                index[own[2 * w]] = len(at) + np.arange(len(own[2 * w]))
                maps = np.concatenate([maps, fold(full[2 * w])])
            self.rows[w] = maps, index

    def possible(self, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of sets i, j their bitmaps don't keep apart; sizes differ by a factor of two at most."""
        ok = np.zeros(len(i), bool)
        least = np.minimum(self.words[i], self.words[j])
        for w in np.unique(least).tolist():
            maps, index = self.rows[w]
            at = np.flatnonzero(least == w)
            for part in np.array_split(at, len(at) * w // 500_000 + 1):
                x, y = i[part], j[part]
                ok[part] = possible(n[x], n[y], maps[index[x]], maps[index[y]], percent)
        return ok

    def linked(self, n: np.ndarray, lo: int, hi: int, percent: int) -> "Links":
        """Components of sets lo .. hi-1, which are in ascending order of size."""
        links = Links(hi - lo)
        for w in np.unique(self.words[lo:hi]).tolist():
            maps, index = self.rows[w]
            at = lo + np.flatnonzero((self.words[lo:hi] == w) | ((self.words[lo:hi] == 2 * w) & (percent * n[lo:hi] <= 100 * 32 * w)))
            wide = self.words[at] > w  # two such sets are compared at their own width
            found = linked(n[at], maps[index[at]], percent, lambda i, j, wide=wide: ~(wide[i] & wide[j]))
            for x in range(len(at)):
                links.join(int(at[x]) - lo, int(at[found.root(x)]) - lo)
        return links


def missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of a that b lacks, summed over the last axis."""
    return np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)


def possible(na, nb, a, b, percent: int):
    """Whether overlaps of sets of these sizes and bitmaps can reach the similarity: elementwise."""
    most = np.minimum(na - missing(a, b), nb - missing(b, a))
    return most * (100 + percent) >= percent * (na + nb)


class Links:
    """Union-find over 0 .. n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.parts = n

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
            self.parts -= 1

    def one(self, lo: int, hi: int) -> int:
        """The common root of lo .. hi-1, or -1."""
        r = self.root(lo)
        return r if all(self.root(i) == r for i in range(lo + 1, hi)) else -1


def linked(sizes: np.ndarray, maps: np.ndarray, percent: int, verify: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, every_pair: bool = False) -> Links:
    """Components of sets in ascending order of size.

    verify(i, j) tells which pairs i < j are linked, of those that signatures can't exclude; without it all of these are.
    With ``every_pair`` it is asked about each such pair once, else nodes that are connected already aren't compared.
    """
    n, links = len(sizes), Links(len(sizes))
    levels = [(np.arange(0, n, LEAF), np.minimum(np.arange(0, n, LEAF) + LEAF, n))]
    while len(levels[-1][0]) > 1:
        lo, hi = levels[-1]
        at = np.arange(0, len(lo), FANOUT)
        levels.append((lo[at], hi[np.minimum(at + FANOUT, len(lo)) - 1]))
    nodes = [[np.bitwise_or.reduceat(maps, lo), np.bitwise_and.reduceat(maps, lo), sizes[lo], sizes[hi - 1], lo, hi] for lo, hi in levels]

    def leaves(a: slice, b: slice) -> None:
        ok = possible(sizes[a, None], sizes[None, b], maps[a, None], maps[None, b], percent)
        ok &= 100 * sizes[a, None] >= percent * sizes[None, b]
        i, j = np.nonzero(ok)
        i, j = i + a.start, j + b.start
        i, j = i[i < j], j[i < j]
        if verify is not None:
            sure = verify(i, j)
            i, j = i[sure], j[sure]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            links.join(x, y)

    stack = [(len(levels) - 1, 0, 0)]
    while stack and (every_pair or links.parts > 1):
        level, u, v = stack.pop()
        some, every, low, high, lo, hi = nodes[level]
        if 100 * high[u] < percent * low[v]:
            continue
        most = min(high[u] - missing(every[u], some[v]), high[v] - missing(every[v], some[u])) if u != v else high[u]
        if most * (100 + percent) < percent * (low[u] + low[v]):
            continue
        if level == 0:
            if every_pair or (r := links.one(lo[u], hi[u])) < 0 or (u != v and links.one(lo[v], hi[v]) != r):
                leaves(slice(int(lo[u]), int(hi[u])), slice(int(lo[v]), int(hi[v])))
            continue
        below = len(nodes[level - 1][4])
        us, vs = (range(x * FANOUT, min((x + 1) * FANOUT, below)) for x in (u, v))
        stack += [(level - 1, i, j) for i in reversed(us) for j in reversed(vs) if i <= j]
    return links
