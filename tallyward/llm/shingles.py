"""Word shingles of whole texts as weighted sets."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_texts

WORD = re.compile(r"\w+")
#: ASCII characters that are no word characters become spaces.
WORD_CHARS = "".join(chr(c) if WORD.match(chr(c)) else " " for c in range(128))
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Slots of the table of document frequencies that every task gets (4 bytes each). A word counts in two of them and its frequency
#: is read as the smaller one: exact unless other words fall on both, whatever the number of words.
SLOTS = 1 << 21
#: Partial counts of a task are handed on and dropped beyond so many different words.
FLUSH_WORDS = 300_000


def words(text: str) -> list[str]:
    text = text.lower()
    return text.translate(WORD_CHARS).split() if text.isascii() else WORD.findall(text)


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class WordWeights:
    """Inverse document frequencies 1 + ln((1 + N) / (1 + n)) of all words, from hashed counts."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total, self.mask = counts, total, len(counts) - 1

    def frequency(self, word: str) -> int:
        h = word_hash(word)
        return min(int(self.counts[h & self.mask]), int(self.counts[(h >> 32) & self.mask]))

    def get(self, word: str, rest: float | None = None) -> float:
        return float(self.of_hashes(np.array([word_hash(word)], np.uint64))[0])

    def of_hashes(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.mask)
        n = np.minimum(self.counts[hashes & mask], self.counts[(hashes >> np.uint64(32)) & mask])
        return 1 + np.log((1 + self.total) / (1 + np.maximum(n, 1).astype(float)))


def slot_counts(seen: dict[str, int], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, n) of counted words; each adds to its two slots, or to one if they are the same."""
    h = np.fromiter(map(word_hash, seen), np.uint64, len(seen))
    n = np.fromiter(seen.values(), np.int64, len(seen))
    first, second = (h & np.uint64(slots - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)
    other = first != second
    at = np.concatenate([first, second[other]])
    order = np.argsort(at, kind="stable")
    at, n = at[order], np.concatenate([n, n[other]])[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    return at[start], np.add.reduceat(n, start) if len(at) else n


def document_frequencies(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, n): in how many rows of (doc_id, text) the words of a slot occur; partial counts are made map-side."""

    def count(blocks) -> Iterator[dict]:
        seen: Counter[str] = Counter()

        def handed():
            at, n = slot_counts(seen, slots)
            return {"slot": at.astype(np.int32), "n": n}

        for _, block in blocks:
            for t in block:
                seen.update(set(words(t)))
            if len(seen) > FLUSH_WORDS:
                yield handed()
                seen.clear()
        yield handed()

    return map_texts(docs, count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def word_weights(docs: DataFrame, slots: int = SLOTS) -> WordWeights:
    """The weights of all words of (doc_id, text). The driver gets at most ``slots`` rows of two numbers."""
    found = document_frequencies(docs, slots).toArrow()
    counts = np.zeros(slots, np.uint32)
    counts[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 32) - 1)
    return WordWeights(counts, docs.count())


class ShingleEncoder:
    """Turns texts into sorted shingle hashes and weights (count times the mean inverse document frequency of the
    shingle's words). A text of fewer words than a shingle is one shingle; a text without words has none."""

    def __init__(self, idf: WordWeights | dict[str, float], rest: float = 1.0, size: int = 5, limit: int = 400_000):
        self.idf, self.rest, self.size, self.limit = idf, rest, size, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.hashes = np.zeros(1024, np.uint64)
        self.weights = np.zeros(1024)

    def add(self, new: list[str]) -> None:
        start, end = len(self.index), len(self.index) + len(new)
        while end > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
        h = np.fromiter(map(word_hash, new), np.uint64, len(new))
        self.hashes[start:end] = h
        self.weights[start:end] = self.idf.of_hashes(h) if isinstance(self.idf, WordWeights) else \
            [self.idf.get(w, self.rest) for w in new]
        self.index.update(zip(new, range(start, end)))

    def features(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.limit:
            self.clear()
        index = self.index
        ids = np.fromiter(map(index.get, tokens, repeat(-1)), np.int64, len(tokens))
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            new = [tokens[k] for k in unknown.tolist()]
            self.add(list(dict.fromkeys(new)))
            ids[unknown] = [index[w] for w in new]
        h, w = self.hashes.take(ids), self.weights.take(ids)
        size = min(self.size, len(ids))
        if not size:
            return np.zeros(0, np.uint64), np.zeros(0)
        n = len(ids) - size + 1
        key = np.full(n, size, np.uint64)
        total = np.zeros(n)
        for k in range(size):
            key = (key ^ h[k:k + n]) * STEP
            key ^= key >> np.uint64(29)
            total += w[k:k + n]
        order = np.argsort(key)
        key, total = key[order], total[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(first, n))
        return key[first], counts * (total[first] / size)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; 0 when either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    low = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


class ConsistentSampler:
    """Improved consistent weighted sampling: ``count`` samples of a weighted set, equal between two sets with
    the probability of their weighted Jaccard similarity. The Gamma(2,1), Gamma(2,1) and uniform draws of an
    element come from a fixed table by its hash."""

    def __init__(self, count: int, seed: int = 7, pool: int = 1 << 16):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, pool).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, pool)).astype(np.float32)
        self.b = rng.random(pool).astype(np.float32)
        self.odd = (rng.integers(1, 1 << 62, (count, 1)).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        self.salt = rng.integers(1, 1 << 62, count).astype(np.uint64)
        self.shift = np.uint64(64 - int(math.log2(pool)))

    def sample(self, keys: np.ndarray, weights: np.ndarray, part: int = 20_000) -> np.ndarray:
        """``count`` 32-bit sample ids; keys sorted and not empty."""
        best = None
        for at in range(0, len(keys), part):
            k, log_w = keys[at:at + part], np.log(weights[at:at + part]).astype(np.float32)
            draw = ((k * self.odd) >> self.shift).view(np.int64)
            r, b, a = self.r.take(draw), self.b.take(draw), self.c.take(draw)
            t = log_w / r
            t += b
            np.floor(t, out=t)
            step = t - b
            step += 1
            step *= r
            a -= step
            low = a.argmin(axis=1)
            rows = np.arange(len(low))
            found = a[rows, low], k[low], t[rows, low]
            if best is None:
                best = found
            else:
                less = found[0] < best[0]
                best = tuple(np.where(less, x, y) for x, y in zip(found, best))
        x = (best[1] ^ (best[2].astype(np.int64).astype(np.uint64) * MIX) ^ self.salt) * STEP
        return (x >> np.uint64(32)).astype(np.uint32)
