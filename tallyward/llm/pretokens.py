"""Token ids of whole texts through cached pre-token chunks.

A byte-level BPE first splits a text by a pattern whose pieces never join white space to what precedes
it. So a text may be cut into chunks (an optional space with a run of other characters, or white
space) and the ids of the text are the ids of its chunks in order. Chunks repeat, so their ids are kept
in a dictionary per worker: a fixed first tier handed in by the caller, and a second tier that is
emptied when it grows beyond ``limit`` entries. Texts that hold an added token's string go through the
library whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: White space of the splitting pattern (fixed values: the Unicode property).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of plain letters is a piece of its own when no further letter can follow; else all up to the next space.
CHUNKS = re.compile(f" ?[{LETTERS}]+(?![{LETTERS}]|[^\\x00-\\x7F])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Longer chunks are encoded each time instead of being kept.
KEEP_CHARS = 48


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class ChunkCoder:
    """Adds up a value per chunk: the number of ids, or the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, first_tier: dict | None = None, as_length: bool = False, limit: int = 500_000):
        self.tokenizer = load_tokenizer(path)
        self.added = added_strings(self.tokenizer)
        self.first = first_tier or {}
        self.cache = dict(self.first)
        self.limit = limit
        self.as_length = as_length

    def encode(self, strings: list[str]) -> list:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [len(e.ids) for e in found] if self.as_length else [array("I", e.ids).tobytes() for e in found]

    def whole(self, text: str):
        """Length or ids of one text."""
        if any(a in text for a in self.added):
            return self.encode([text])[0]
        chunks = CHUNKS.findall(text)
        add = sum if self.as_length else b"".join
        try:
            return add(map(self.cache.__getitem__, chunks))
        except KeyError:
            missing = list(set(chunks).difference(self.cache))
        if len(self.cache) + len(missing) > self.limit:  # start the second tier afresh
            self.cache = dict(self.first)
            missing = list(set(chunks).difference(self.cache))
        self.cache.update(zip(missing, self.encode(missing)))
        out = add(map(self.cache.__getitem__, chunks))
        for c in missing:
            if len(c) > KEEP_CHARS:
                del self.cache[c]
        return out


#: One coder per worker process, tokenizer file and first tier: tasks of a worker share its cache.
CODERS: dict[tuple, ChunkCoder] = {}


def worker_coder(path: str, key: object = None, first_tier: dict | None = None, as_length: bool = False) -> ChunkCoder:
    at = (path, key, as_length)
    if at not in CODERS:
        CODERS.clear()
        CODERS[at] = ChunkCoder(path, first_tier, as_length)
    return CODERS[at]
