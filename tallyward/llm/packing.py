"""Harmonic packing of token sequences.

A document becomes whole sequences of ``capacity`` tokens and a rest. The rest is cut at the reciprocal
capacities capacity/2, capacity/4, ... down to ``grain``, whose bins fill exactly, and a tail shorter than
``grain``. A tail of length t belongs to the class j = capacity // t (length in (capacity/(j+1), capacity/j])
and a bin of class j takes exactly j tails, so a closed bin wastes less than capacity/(j+1). Each worker
fills the bins of each class on its own: nothing is shuffled, and open bins hold fewer than
capacity * (2 + ln(grain)) pieces. What is left in open bins when the worker's rows end is packed largest first into
shared sequences; all but the last of them are nearly full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyward.llm.common import map_texts, texts
from tallyward.llm.pretokens import worker_coder

PIECE_SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity))
        at += capacity
    size = capacity // 2
    while size >= grain and n > at:
        if n - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    if n > at:
        out.append((at, n - at))
    return out


class HarmonicBins:
    """The open bins of one worker. ``put`` and ``rest`` give (piece, sequence number, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[tuple[bool, int], list] = defaultdict(list)
        self.sequences = 0

    def close(self, pieces: list) -> list:
        out, at = [], 0
        for p in pieces:
            out.append((p, self.sequences, at))
            at += p[2]
        self.sequences += 1
        return out

    def put(self, piece: tuple, exact: bool) -> list:
        count = self.capacity // piece[2]
        key = (exact, piece[2] if exact else count)
        self.open[key].append(piece)
        return self.close(self.open.pop(key)) if len(self.open[key]) == count else []

    def rest(self) -> list:
        left = sorted((p for bin_ in self.open.values() for p in bin_), key=lambda p: -p[2])
        self.open.clear()
        bins: list[list] = []
        room: list[int] = []
        for p in left:
            at = next((i for i, r in enumerate(room) if r >= p[2]), None)
            if at is None:
                bins.append([])
                room.append(self.capacity)
                at = len(bins) - 1
            bins[at].append(p)
            room[at] -= p[2]
        return [x for b in bins for x in self.close(b)]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 1024, grain: int = 64, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``keep_ids`` the ids as little-endian unsigned 32-bit integers (``ids``).

    A document's ids are those of its text, special strings by the library's default, then ``end_id``; a
    null or empty text is ``end_id`` alone. Each id is in exactly one piece. Repeated rows are packed each;
    a null id stays null; other columns are ignored; an empty table gives no pieces. ``capacity`` must be a
    power of two and ``grain`` a smaller one. Sequence ids hold the partition number in their high bits, so
    a task that runs again after a lost executor makes the same rows.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or not 0 < grain <= capacity:
        raise ValueError("capacity and grain must be powers of two, grain not above capacity")
    source = texts(docs, id_col, text_col)
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def pack(blocks):
        coder, bins = worker_coder(tokenizer_path), HarmonicBins(capacity)
        base = TaskContext.get().partitionId() << 40

        def table(placed):
            rows = [(*p[:5], base + s, o, *p[5:]) for p, s, o in placed]
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        for ids, block in blocks:
            placed = []
            for doc, t in zip(ids, block):
                data = coder.whole(t) + end
                n = len(data) // 4
                for start, length in cuts(n, capacity, grain):
                    part = data[4 * start:4 * (start + length)]
                    piece = (doc, start, length, zlib.crc32(part), n, *([part] if keep_ids else []))
                    placed += bins.put(piece, length >= grain)
            yield table(placed)
        yield table(bins.rest())

    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, pack, f"doc_id {id_type}, {PIECE_SCHEMA}" + ", ids binary" * keep_ids)
