"""Sets of word shingles as sorted 64-bit hashes, with numpy inside tasks."""

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WORDS = 5
#: Words whose hash a worker remembers; the memory is emptied beyond that.
REMEMBERED = 200_000
# Odd factors that keep the places of a shingle apart.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) & (2**64 - 1) | 1 for k in range(WORDS)], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits; one to one."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
    return hashes ^ (hashes >> np.uint64(31))


def shingle_set(text: bytes | None, memory: WordHashes) -> np.ndarray:
    """Distinct shingles, sorted. bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split() if text else []
    hashes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    if not len(hashes):
        return hashes
    width = min(WORDS, len(hashes))
    n = len(hashes) - width + 1
    sums = np.zeros(n, np.uint64)
    for k in range(width):
        sums += hashes[k : k + n] * PLACES[k]
    sums = mixed(sums)
    sums.sort()
    return sums[np.concatenate(([True], sums[1:] != sums[:-1]))]


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    memory = WordHashes()
    for text in texts:
        yield shingle_set(text, memory)
