"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set: it is read in blocks of ``block_items`` items, and each block is searched
against all rows of the corpus.

1. Every text becomes the ids of its benchmark words, in order (0: another word), cut into passages of two
   neighbouring strides. In how many different strides each word occurs is counted over the whole corpus, by the strides' digests.
2. A randomised SVD of the TF-IDF matrix A of all passages (corpus passages side by side, and benchmark passages
   weighted to the same total) gives the latent space: one pass multiplies a random basis by A^T A in the tasks that
   hold the passages and adds up one matrix of vocabulary x sketch; the Nystrom formula gives the singular vectors.
3. In the last pass a task projects its passages, takes those whose latent cosine with an item's passage reaches
   ``cosine``, and besides all those that hold enough words of such a passage (counted exactly, so that no copy depends
   on the rank), and compares the words around them with the item: longest common subsequence of the informative
   words, and, for loose matches, of the item's answer (its last words). Nothing but hits leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_texts, staged, texts
from tallyward.llm.shingles import words

STRIDE = 32
RANK, SKETCH = 64, 96
ROWS_AT_ONCE = 400_000
FAN_IN = 256
#: Strides without a word that are added to every table's before a word's share of them is judged.
PRIOR_STRIDES = 400


def to_terms(source: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, terms, prints): terms as unsigned 16-bit ids per text, and a 64-bit digest of the words of each stride."""
    spark = source.sparkSession
    table = spark.sparkContext.broadcast(vocabulary)

    def encode(blocks) -> Iterator[dict]:
        ids = table.value
        for docs, block in blocks:
            rows, prints = [], []
            for t in block:
                tokens = words(t)
                row = np.fromiter(map(ids.get, tokens, repeat(0)), np.uint16, len(tokens)) if tokens else \
                    np.zeros(0, np.uint16)
                rows.append(row.tobytes())
                prints.append(b"".join(blake2b(" ".join(tokens[at:at + STRIDE]).encode(), digest_size=8).digest()
                                       for at in range(0, len(tokens), STRIDE)))
            yield {"doc_id": docs, "terms": rows, "prints": prints}

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, encode, f"doc_id {kind}, terms binary, prints binary")


def stride_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """In how many different strides of the corpus each id occurs (id 0: all different strides). A text repeated any number of
    times counts once, however the rows are dealt to tasks: strides are told apart by their digests, over the whole corpus."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, prints = (c.to_pylist() for c in b.columns)
            flat = np.frombuffer(b"".join(terms), np.uint16)
            sizes = np.array([len(t) // 2 for t in terms])
            strides = -(-sizes // STRIDE)
            first = np.cumsum(strides) - strides
            within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            stride = np.repeat(first, sizes) + within // STRIDE
            pairs = np.unique(stride[flat > 0] * 65_536 + flat[flat > 0])
            data = (pairs & 65_535).astype(np.uint16)
            at = np.searchsorted(pairs >> 16, np.arange(int(strides.sum()) + 1))
            digest, seen = np.unique(np.frombuffer(b"".join(prints), np.int64), return_index=True)
            held = [data[at[k]:at[k + 1]].tobytes() for k in seen.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(held, pa.binary())], names=["digest", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint16)
            total += np.bincount(ids, minlength=size)
            total[0] += b.num_rows
        yield pa.RecordBatch.from_pydict({"part": [0], "v": [total.tobytes()]})

    strides = encoded.select("terms", "prints").mapInArrow(cut, "digest long, held binary").dropDuplicates(["digest"])
    return added_up(strides.select("held").mapInArrow(add, "part long, v binary"), size)


def added_up(frame: DataFrame, size: int, rows: int = 1) -> np.ndarray:
    """Element-wise sum of the double vectors in (part, v), ``rows`` parts in order. Parts are summed on the cluster, first
    in ``FAN_IN`` groups of tasks each and then as a whole; the driver gets one vector per part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(v)
                total[part] = total[part] + v if part in total else v
        if total:
            yield pa.RecordBatch.from_pydict({"part": list(total), "v": [v.tobytes() for v in total.values()]})

    halfway = frame.repartition("part", F.spark_partition_id() % FAN_IN).mapInArrow(add, "part long, v binary")
    found = halfway.repartition("part").mapInArrow(add, "part long, v binary").collect()
    out = {r["part"]: np.frombuffer(r["v"]) for r in found}
    return np.concatenate([out.get(p, np.zeros(size)) for p in range(rows)])


def strided(rows: list[bytes], weight: np.ndarray):
    """Informative words of a block of texts: (terms, stride of each, first stride of each text, number of strides)."""
    arrays = [np.frombuffer(r, np.uint16) for r in rows]
    strides = np.array([max(1, -(-len(a) // STRIDE)) for a in arrays])
    first = np.concatenate([[0], np.cumsum(strides)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint16)
    lengths = np.array([len(a) for a in arrays])
    start = np.repeat(first[:-1] * STRIDE - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    keep = np.flatnonzero(weight[flat] > 0)
    return flat[keep], (keep + start[keep]) // STRIDE, first, int(first[-1])


def summed(matrix: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``matrix`` added up by their (ascending) number ``at``."""
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[starts]] = np.add.reduceat(matrix, starts, axis=0)
    return out


def passages(per_stride: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Passage i is stride i and the next one of the same text."""
    out = per_stride.copy()
    out[:-1] += per_stride[1:]
    last = first[1:] - 1
    out[last] = per_stride[last]
    return out


def gram_times(encoded: DataFrame, weight: np.ndarray, basis: np.ndarray, slab: int = 256) -> np.ndarray:
    """A^T A basis over the corpus, cut into passages of two strides that do not overlap."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((weight, (weight[:, None] * basis).astype(np.float32)))
    v, k = basis.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, scaled = shared.value
        total = np.zeros((v, k))
        for b in batches:
            column = b.column(0).to_pylist()
            at = 0
            while at < len(column):
                size, start = 0, at
                while at < len(column) and (size == 0 or size + len(column[at]) <= 2 * ROWS_AT_ONCE):
                    size += len(column[at])
                    at += 1
                terms, stride, first, n = strided(column[start:at], weight)
                row = np.searchsorted(first, stride, "right") - 1
                passage = stride - (stride - first[row]) % 2
                y = summed(scaled[terms], passage, n)
                order = np.argsort(terms, kind="stable")
                total += summed(y[passage[order]], terms[order], v)
        total *= weight[:, None]
        for part in range(0, -(-v // slab)):
            rows = np.zeros((slab, k))
            own = total[part * slab:(part + 1) * slab]
            rows[:len(own)] = own
            yield pa.RecordBatch.from_pydict({"part": [part], "v": [rows.tobytes()]})

    parts = -(-v // slab)
    sums = added_up(encoded.select("terms").mapInArrow(multiply, "part long, v binary"),
                    slab * k, parts)
    return sums.reshape(-1, k)[:v]


def latent_axes(encoded: DataFrame, weight: np.ndarray, queries: np.ndarray, total: int, rank: int) -> np.ndarray:
    """Leading right singular vectors (vocabulary x rank) of the TF-IDF matrix, by a single-pass Nystrom sketch."""
    size = min(max(rank, SKETCH), max(1, int((weight > 0).sum())))
    basis = np.random.default_rng(11).standard_normal((len(weight), size))
    basis[weight == 0] = 0
    basis, _ = np.linalg.qr(basis)
    share = max(total, 1) / max(len(queries), 1)
    product = gram_times(encoded, weight, basis) + share * (queries.T @ (queries @ basis))
    core, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
    good = core > 1e-9 * max(core[-1], 1e-30)
    axes, _, _ = np.linalg.svd(product @ turn[:, good] / np.sqrt(core[good]), full_matrices=False)
    return axes[:, :rank]


def word_places(a: list[int]) -> dict[int, int]:
    """Where each word stands in ``a``, as bits."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    return place


def common_subsequence(a: list[int], b: list[int], place: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``; ``place`` is ``word_places`` of ``a``, if at hand."""
    place = word_places(a) if place is None else place
    full = row = (1 << len(a)) - 1
    for x in b:
        if x in place:
            u = row & place[x]
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def member_counts(ids: np.ndarray, left: np.ndarray, right: np.ndarray, item: np.ndarray, members: np.ndarray,
                  part: int = 50_000) -> np.ndarray:
    """For each k, how many of ids[left[k]:right[k]] are words of item[k]."""
    out = np.zeros(len(item), np.int64)
    for low in range(0, len(item), part):
        a, n = left[low:low + part], (right - left)[low:low + part]
        owner = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        hit = members[np.repeat(item[low:low + part], n), ids[at]]
        out[low:low + part] = np.bincount(owner, hit, len(a))
    return out


def bags(words_of: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(item * 65,536 + word, times the item has it), ascending."""
    keys = [np.array(t, np.int64) + i * 65_536 for i, t in enumerate(words_of)]
    return np.unique(np.concatenate(keys), return_counts=True)


def bag_overlap(ids: np.ndarray, left: np.ndarray, right: np.ndarray, item: np.ndarray, bag: tuple[np.ndarray, np.ndarray],
                members: np.ndarray, part: int = 50_000) -> np.ndarray:
    """For each k, how many words of item[k] can be matched with one of ids[left[k]:right[k]] each: no common subsequence is longer."""
    keys, times = bag
    out = np.zeros(len(item), np.int64)
    for low in range(0, len(item), part):
        a, n, own = left[low:low + part], (right - left)[low:low + part], item[low:low + part]
        owner = np.repeat(np.arange(len(a)), n)
        word = ids[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)].astype(np.int64)
        hit = members[own[owner], word]
        found, held = np.unique(owner[hit] * 65_536 + word[hit], return_counts=True)
        owner, word = found >> 16, found & 65_535
        most = times[np.searchsorted(keys, own[owner] * 65_536 + word)]
        out[low:low + part] = np.bincount(owner, np.minimum(held, most), len(a))
    return out


def shared_words(ids: np.ndarray, stride: np.ndarray, first: np.ndarray, postings: tuple[np.ndarray, np.ndarray],
                 needed: np.ndarray, at_once: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(passage, query) pairs that share at least ``needed[query]`` words, a word counting once per stride. ``postings``: first
    place of each word's queries, and the queries. ``stride`` ascends."""
    begin, listed = postings
    n, width = int(first[-1]), len(needed)
    last = np.zeros(n + 1, bool)
    last[first[1:] - 1] = True
    pairs = np.unique(stride.astype(np.int64) * 65_536 + ids)
    at, word = pairs >> 16, pairs & 65_535
    step = max(1, at_once // max(width, 1))
    found_p, found_q = [], []
    for low in range(0, n, step):
        high = min(n, low + step)
        a, b = np.searchsorted(at, [low, high + 1])  # one stride more, for the last passage
        size = begin[word[a:b] + 1] - begin[word[a:b]]
        owner = np.repeat(at[a:b] - low, size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[word[a:b]], size)
        held = np.bincount(owner * width + listed[place], minlength=(high + 1 - low) * width).reshape(-1, width)
        whole = held[:-1] + np.where(last[low:high, None], 0, held[1:])
        p, q = np.nonzero(whole >= needed)
        found_p.append(p + low)
        found_q.append(q)
    return (np.concatenate(found_p), np.concatenate(found_q)) if found_p else (np.zeros(0, int), np.zeros(0, int))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK, cosine: float = 0.4,
               cover: float = 0.6, loose_cover: float = 0.4, answer_words: int = 4, common: float = 0.05,
               block_items: int = 1024) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, cover (share of the item's
    informative words in the longest common subsequence), answer (share of the answer's), kind (``copy`` or
    ``paraphrase``).

    A word is informative unless it occurs in more than ``common`` of all different strides, ``PRIOR_STRIDES`` without it added
    (repeated text counts once); an item with fewer than four other words uses all of its words. A copy covers at least ``cover`` of the item; a paraphrase at least
    ``loose_cover`` and four fifths of the answer, the item's last ``answer_words`` informative words, in order; both
    share at least four informative words with it, or all of them. Null and wordless texts and items
    match nothing; equal rows give one row; equal items give a row each; other columns are ignored; an empty
    corpus or benchmark gives an empty result.
    """
    source = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    items = staged(texts(benchmark, item_col, item_text_col).distinct()
                   .select(F.col("doc_id").alias("item_id"), "text"), "items")
    n_items = items.count()
    kinds = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " \
            f"item_id {items.schema['item_id'].dataType.simpleString()}"
    schema = f"{kinds}, cosine double, cover double, answer double, kind string"
    found = spark.createDataFrame([], schema)
    blocks = -(-n_items // block_items)
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if blocks > 1 \
            else items.collect()
        block = sorted(((r["item_id"], words(r["text"])) for r in part if r["item_id"] is not None),
                       key=lambda x: (x[0], x[1]))
        block = [x for x in block if x[1]]
        if block:
            found = found.unionByName(search_block(source, block, schema, rank, cosine, cover, loose_cover,
                                                   answer_words, common))
    return found.dropDuplicates(["doc_id", "item_id"])


def search_block(source: DataFrame, block: list[tuple], schema: str, rank: int, cosine: float, cover: float,
                 loose_cover: float, answer_words: int, common: float) -> DataFrame:
    spark = source.sparkSession
    names = sorted({w for _, tokens in block for w in tokens})
    if len(names) > 65_535:  # ids have 16 bits: halve the block
        half = len(block) // 2
        if not half:
            raise ValueError("a benchmark item has more than 65535 different words")
        rest = rank, cosine, cover, loose_cover, answer_words, common
        return search_block(source, block[:half], schema, *rest).unionByName(
            search_block(source, block[half:], schema, *rest))
    vocabulary = {w: i + 1 for i, w in enumerate(names)}
    encoded = staged(to_terms(source, vocabulary), "terms")

    counts = stride_counts(encoded, len(names) + 1)
    total, counts = max(int(counts[0]), 1), counts.copy()
    counts[0] = 0
    weight = np.log((1 + total) / (1 + counts))
    informative = counts <= common * (total + PRIOR_STRIDES)
    informative[0] = False
    terms = [[vocabulary[w] for w in tokens] for _, tokens in block]
    for t in terms:
        if len({x for x in t if informative[x]}) < 4:
            informative[t] = True
    weight[~informative] = 0
    weight[informative] = np.maximum(weight[informative], 1e-3)

    whole, answers, owner, vectors, held = [], [], [], [], []
    for i, t in enumerate(terms):
        kept = [x for x in t if informative[x]]
        whole.append(kept)
        answers.append(kept[-answer_words:])
        for at in range(0, max(1, len(t) - STRIDE), STRIDE):
            v = np.zeros(len(weight))
            np.add.at(v, [x for x in t[at:at + 2 * STRIDE] if informative[x]], 1)
            owner.append(i)
            held.append(np.flatnonzero(v))
            vectors.append(v * weight)
    queries = np.array(vectors)
    axes = latent_axes(encoded, weight, queries, total, rank)
    latent = queries @ axes
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    # the nearest passage of a text holds at least three quarters of an item's passage
    least = np.array([max(min(4, len(h)), int(np.ceil(0.75 * loose_cover * len(h))), 1) for h in held])
    order = np.argsort(np.concatenate(held), kind="stable")
    listed = np.repeat(np.arange(len(held)), [len(h) for h in held])[order]
    begin = np.searchsorted(np.concatenate(held)[order], np.arange(len(weight) + 1))
    shared = spark.sparkContext.broadcast(
        ((begin, listed), least, weight, (weight[:, None] * axes).astype(np.float32), latent.astype(np.float32).T, np.array(owner),
         [b[0] for b in block], whole, answers))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, least, weight, scaled, latent, owner, item_ids, whole, answers = shared.value
        sizes = np.array([len(t) for t in terms])
        back, ahead = 1 + sizes // STRIDE, 2 + np.maximum(3 * STRIDE, sizes) // STRIDE
        lengths = np.array([len(t) for t in whole])
        needed = np.maximum(np.ceil(loose_cover * lengths), np.minimum(4, lengths))
        members = np.zeros((len(whole), len(weight)), bool)
        for i, t in enumerate(whole):
            members[i, t] = True
        bag = bags(whole)
        places, answer_places = [word_places(t) for t in whole], [word_places(t) for t in answers]
        for b in batches:
            docs, column = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(column):
                size, start = 0, at
                while at < len(column) and (size == 0 or size + len(column[at]) <= 2 * ROWS_AT_ONCE):
                    size += len(column[at])
                    at += 1
                ids, stride, first, n = strided(column[start:at], weight)
                y = passages(summed(scaled[ids], stride, n), first)
                norm = np.linalg.norm(y, axis=1)
                exact_p, exact_q = shared_words(ids, stride, first, postings, least)
                some = np.union1d(np.flatnonzero(norm > 0), exact_p).astype(np.int64)
                norm = np.maximum(norm, 1e-12)
                best: dict[tuple[int, int], tuple] = {}
                for low in range(0, len(some), 20_000):
                    rows = some[low:low + 20_000]
                    near = (y[rows] @ latent) / norm[rows, None]
                    candidate = near >= cosine
                    a, b = np.searchsorted(exact_p, [rows[0], rows[-1] + 1])
                    r = np.minimum(np.searchsorted(rows, exact_p[a:b]), len(rows) - 1)
                    known = rows[r] == exact_p[a:b]
                    candidate[r[known], exact_q[a:b][known]] = True
                    r, q = np.nonzero(candidate)
                    passage, item, c = rows[r], owner[q], near[r, q]
                    row = np.searchsorted(first, passage, "right") - 1
                    left = np.searchsorted(stride, np.maximum(first[row], passage - back[item]))
                    right = np.searchsorted(stride, np.minimum(first[row + 1], passage + ahead[item]))
                    # no common subsequence is longer than the number of words around that the item has at all
                    keep = np.flatnonzero(member_counts(ids, left, right, item, members) >= needed[item])
                    keep = keep[bag_overlap(ids, left[keep], right[keep], item[keep], bag, members) >= needed[item[keep]]]
                    for row, item, c, left, right in zip(*(a[keep].tolist() for a in (row, item, c, left, right))):
                        region = ids[left:right].tolist()
                        equal = common_subsequence(whole[item], region, places[item])
                        share = equal / len(whole[item])
                        if share < loose_cover or equal < min(4, len(whole[item])):
                            continue
                        answer = common_subsequence(answers[item], region, answer_places[item]) / len(answers[item])
                        if share < cover and answer < 0.8:
                            continue
                        old = best.get((row, item))
                        if old is None or (share, c) > old[:2]:
                            best[row, item] = (share, c, answer)
                if best:
                    yield pa.RecordBatch.from_arrays([
                        docs.take(pa.array([start + r for r, _ in best])),
                        pa.array([item_ids[i] for _, i in best]),
                        pa.array([float(x[1]) for x in best.values()]), pa.array([x[0] for x in best.values()]),
                        pa.array([x[2] for x in best.values()]),
                        pa.array(["copy" if x[0] >= cover else "paraphrase" for x in best.values()])],
                        names=["doc_id", "item_id", "cosine", "cover", "answer", "kind"])

    return (encoded.filter("doc_id is not null").select("doc_id", "terms")
            .mapInArrow(search, schema))
