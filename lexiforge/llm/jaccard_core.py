"""Shingle sets and segment signatures of the n-gram Jaccard join, on numpy arrays.

Two sets of sizes x <= y with 100 * i >= P * (x + y - i), where i is the size of their intersection,
differ in at most (x + y) * (100 - P) / (100 + P) elements. Sizes fall into bands; for pairs whose larger
set lies in a band, with H the bound of the difference there, the universe is dealt by hash into segments.
A segment is indexed by its subset (units: 1), which finds pairs alike in it, or by the subset and all its
one-deletion neighbours (units: 2), which find those that differ in one element of it as well. Segments of
H + 1 units in all cannot each hold more differences than they tolerate, so that one of them finds the pair.

Allocation by cost: small bands take neighbours (few, large segments: selective, a signature for each
element), large bands plain subsets (a signature for every five elements or so). In a small band a segment
has twelve elements or so, however small the sets, and all segments are indexed: one set in ten thousand has
a segment of at most one element, which unrelated sets may share. A large band has spare segments: a pair is
alike in more of them than a set may leave out, so that each set leaves out the ``spare`` segments that cost
most in an order common to all sets: those of the fewest elements, as they are the likeliest to be shared by
unrelated sets, ties by signature. The cheapest segment that a pair has in common is then indexed by both.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash

GROWTH = 1.3
#: Bands below this size index one-deletion neighbours.
SMALL = 100
#: Subsets of so few elements are likely shared by unrelated sets; the spare segments are meant for them.
WEAK = 1
#: Cells of the counts that bound how much two sets differ.
CELLS = 256
#: Elements, counted once for each of their set's bands, whose signatures are made at once.
PIECE = 1 << 19
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well-spread bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of these lengths start and end."""
    ends = np.cumsum(counts)
    return ends - counts, ends


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of runs with these starts and lengths, one run after the other."""
    return np.repeat(starts - spans(counts)[0], counts) + np.arange(counts.sum())


def sums(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of ``x``, modulo 2^64."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
    return total[ends] - total[starts]


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct n-word shingles, one text after the other, and how many each has; of all words where there are fewer; none without words."""
    words = [(text or "").encode().lower().split() for text in texts]
    many = np.fromiter(map(len, words), np.int64, len(words))
    h = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), U64, int(many.sum())))
    del words
    counts = np.where(many < n, many > 0, many - n + 1).astype(np.int64)
    starts, ends = spans(counts)
    found = np.zeros(int(counts.sum()), U64)
    for width in (n, *np.unique(many[(many > 0) & (many < n)]).tolist()):
        chosen = np.flatnonzero(many >= n if width == n else many == width)
        at = runs(spans(many)[0][chosen], counts[chosen])
        total = np.zeros(len(at), U64)
        for k in range(width):
            total = total * U64(0x9E3779B97F4A7C15) + h[at + k]
        found[runs(starts[chosen], counts[chosen])] = mixed(total + U64(width))
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - start > 1:
            found[start:end].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[starts[counts > 0]] = True
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])
    return found[new], kept[ends] - kept[starts]


def set_ids(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set."""
    return mixed(sums(mixed(s ^ U64(0xD6E8FEB86659FD93)), *spans(counts)) + counts.astype(U64))


def cell_counts(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many elements of each set fall into each cell, 255 at most."""
    at = np.repeat(np.arange(len(counts)) * CELLS, counts) + ((s >> U64(8)).astype(np.int64) & (CELLS - 1))
    return np.minimum(np.bincount(at, minlength=len(counts) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)


def cells(s: np.ndarray) -> bytes:
    """The counts of one set."""
    return cell_counts(s, np.array([len(s)])).tobytes()


def plausible(sizes: np.ndarray, counts: np.ndarray, percent: int, apart: np.ndarray | None = None, queries: int | None = None) -> np.ndarray:
    """Which sets may pair with another one here: two sets differ at least as much as their cells' counts do.

    With ``apart``, only with one of another number; with ``queries``, only pairs with one of the first so many sets.
    """
    k = len(sizes)
    found = np.zeros(k, bool)
    counts = counts.astype(np.int16)
    for i in range(k - 1 if queries is None else queries):
        least = np.abs(counts[i + 1 :] - counts[i]).sum(1, dtype=np.int64)
        near = (100 + percent) * least <= (100 - percent) * (sizes[i + 1 :] + sizes[i])
        if apart is not None:
            near &= apart[i + 1 :] != apart[i]
        found[i] |= near.any()
        found[i + 1 :] |= near
    return found


@lru_cache(None)
def band_of(size: int) -> int:
    return next(b for b in range(10_000) if size < math.ceil(GROWTH ** (b + 1)))


@lru_cache(None)
def band(b: int, percent: int) -> tuple[int, int, int, int]:
    """Least size, segments, how many a set may leave out, units of a segment (0: only equal sets pair)."""
    low, high = math.ceil(GROWTH**b), math.ceil(GROWTH ** (b + 1)) - 1
    differ = 2 * high * (100 - percent) // (100 + percent)
    if not differ:
        return low, 0, 0, 0
    if low < SMALL:
        return low, (differ + 2) // 2, 0, 2
    spare = 0
    for _ in range(20):
        mean = low / (differ + 1 + spare)
        weak = (differ + 1 + spare) * sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(WEAK + 1))
        spare = min(differ + 1, math.ceil(weak + 2 * math.sqrt(weak)))
    return low, differ + 1 + spare, spare, 1


@lru_cache(None)
def bands(size: int, percent: int) -> tuple[tuple[int, int, int, int], ...]:
    """The bands where a set of this size may stand in a pair: number, segments, how many a set may leave out, units."""
    found, b = [], band_of(size)
    while size and (figures := band(b, percent))[0] <= size * 100 // percent:
        if figures[3]:
            found.append((b, *figures[1:]))
        b += 1
    return tuple(found)


def signatures(s: np.ndarray, counts: np.ndarray, percent: int):
    """Of sets that lie one after the other, in pieces of about PIECE elements: the indexed subsets' numbers, and each one's set."""
    listed = [(k, *band) for k, size in enumerate(counts.tolist()) for band in bands(size, percent)]
    if not listed:
        return
    pairs = np.array(listed, np.int64)
    starts = spans(counts)[0]
    ends = np.cumsum(counts[pairs[:, 0]])
    at = 0
    while at < len(pairs):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield piece(s, starts, counts, *pairs[at:end].T)
        at = end


def piece(s: np.ndarray, starts: np.ndarray, counts: np.ndarray, of: np.ndarray, b: np.ndarray, segments: np.ndarray, spare: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the indexed subsets, and each one's set, of sets ``of`` in one band each."""
    n = counts[of]
    elements = s[runs(starts[of], n)]
    first = spans(segments)[0]
    # sets are sorted, and segments follow the leading bits
    at = ((elements >> U64(33)) * np.repeat(segments, n).astype(U64) >> U64(31)).astype(np.int64) + np.repeat(first, n)
    held = np.bincount(at, minlength=int(segments.sum()))
    elements = mixed(elements + np.repeat(b, n).astype(U64))
    pair = np.repeat(np.arange(len(of)), segments)
    place = np.arange(len(pair)) - first[pair]
    name = mixed(place.astype(U64) + (b.astype(U64) << U64(32))[pair])
    total = sums(elements, *spans(held))
    whole = mixed(total + name)
    indexed = np.ones(len(pair), bool)
    if (units == 1).any():
        # the cheapest: those of the most elements, ties by signature
        order = np.argsort(whole)
        order = order[np.argsort(((pair << 32) - held)[order], kind="stable")]
        indexed[order] = place < (segments - spare)[pair]
    deleted = (units == 2)[np.repeat(np.arange(len(of)), n)]
    near = at[deleted]
    return np.concatenate([whole[indexed], mixed((total + name)[near] - elements[deleted])]), of[np.concatenate([pair[indexed], pair[near]])]


def linked(sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None, queries: int | None = None) -> np.ndarray:
    """For each set the index of the first one of its component, by links among these sets.

    ``apart`` gives components known before: their members count as linked. With ``queries``, only pairs
    with one of the first so many sets are looked at; else each set outside the largest component so far is
    held against all others, beginning with the first.
    """
    k = len(sets)
    root = np.arange(k) if apart is None else np.unique(apart, return_index=True)[1][np.unique(apart, return_inverse=True)[1]]
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    left, i = np.arange(k) < (k if queries is None else queries), 0
    while len(left) and left[i] and (root != root[i]).any():
        left[i] = False
        low, high = np.searchsorted(elements, sets[i], "left"), np.searchsorted(elements, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=k)
        alike = 100 * both >= percent * (sizes + sizes[i] - both)
        for j in np.unique(root[np.flatnonzero(alike)]):
            if j != root[i]:
                a, b = min(j, root[i]), max(j, root[i])
                root[root == b] = a
        # sets of the largest component are linked; only those outside it are still to be held against all
        i = int(np.argmax(left & (root != np.bincount(root).argmax()) if queries is None else left))
    return root
