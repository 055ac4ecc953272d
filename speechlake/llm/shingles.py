"""Word shingles of whole texts as weighted sets of 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers: of the polynomial over bytes, of words by place in a shingle, of the final mix.
BASE = 0x9E3779B97F4A7C15
PLACES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a uint64 over the whole word."""
    x = (x ^ (x >> U(30))) * U(PLACES[0])
    x = (x ^ (x >> U(27))) * U(PLACES[1])
    return x ^ (x >> U(31))


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, last three bytes as a number) of every word of every text, in order.

    A shorter word's number holds its own bytes only, whatever white space is before it. Words are runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial over its bytes modulo
    2 ** 64, taken for all words from prefix sums, and mixed with its length.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"  " + b" ".join(encoded) + b" ", np.uint8)
    begins = np.cumsum([2] + [len(e) + 1 for e in encoded])
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    powers = np.full(len(data), BASE, U)
    powers[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(powers, out=powers)
        sums = np.cumsum((data.astype(U) + U(1)) * powers)
        # the sum over a word is divided by its first power, through the inverse power from the other side
        inverse = np.full(len(data), pow(BASE, -1, 1 << 64), U)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        value = (sums[ends - 1] - sums[starts - 1]) * inverse[starts]
        lengths = ends - starts
        hashed = mix(value + lengths.astype(U) * U(PLACES[2]))
        tail = data[ends - 1].astype(np.int64) | data[ends - 2].astype(np.int64) << 8 | data[ends - 3].astype(np.int64) << 16
        tail &= (1 << 8 * np.minimum(lengths, 3)) - 1
    return np.searchsorted(begins, starts, side="right") - 1, hashed, tail


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times) with each shingle of a text once, sorted by text, then hash.

    A text with fewer words than size has one shingle, of all its words; one without words has none.
    """
    owner, words, _ = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    firsts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        rolled = np.zeros(n, U)
        for i in range(size):
            rolled += words[i : i + n] * U(PLACES[i])
        whole = owner[:n] == owner[size - 1 : size - 1 + n]
        owners, shingles = owner[:n][whole], mix(rolled[whole])
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            of = []
            for d in short:
                own = words[firsts[d] : firsts[d] + counts[d]]
                of.append((own * np.array(PLACES[: len(own)], U)).sum(dtype=U) + U(len(own)))
            owners, shingles = np.concatenate([owners, short]), np.concatenate([shingles, mix(np.array(of, U))])
    order = np.lexsort((shingles, owners))
    owners, shingles = owners[order], shingles[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (shingles[1:] != shingles[:-1])
    at = np.flatnonzero(new)
    return owners[at], shingles[at], np.diff(np.append(at, len(owners)))


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of left[i] and right[i]; 0 where neither has any."""
    (a, x, m), (b, y, n) = shingle_sets(left), shingle_sets(right)
    pair, shingle, times = np.concatenate([a, b]), np.concatenate([x, y]), np.concatenate([m, n])
    order = np.lexsort((shingle, pair))
    pair, shingle, times = pair[order], shingle[order], times[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
    common = np.bincount(pair[same], np.minimum(times[same], times[same + 1]), len(left))
    total = np.bincount(pair, times, len(left))
    return np.divide(common, total - common, out=np.zeros(len(left)), where=total > 0)
