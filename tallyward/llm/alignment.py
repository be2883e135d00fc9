"""Alignment of two tokenizers' tokens by an associative fragment monoid.

A tokenizer's tokens cut the bytes of a text; places where tokens of both end cut it into groups. What a byte range of a text says
about its groups is a ``Fragment``: an open prefix (tokens before the first place where tokens of both begin), closed groups, and
an open suffix. ``compose`` joins the fragments of neighbouring ranges and is associative, so the chunks of a very long
document are encoded in tasks of their own and reduced in a tree. Each tokenizer's share of a chunk begins at the first place of
the chunk where that tokenizer can be restarted, which is not the same for both, so groups do reach across chunks.

Texts up to ``CHUNK`` characters are encoded whole, and the groups of a block of them are found with array operations.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_texts, staged, texts
from tallyward.llm.pretokens import SPACE, ChunkCoder

#: Longer texts are cut into chunks of so many characters.
CHUNK = 65_536
#: Fragments composed by one task of the tree.
FAN = 16
#: Pairs whose counts are broadcast (12 bytes each); the others are joined.
TABLE_SIZE = 1 << 20
#: Pre-tokens of the first tokenizer whose ids a worker keeps (about 200 bytes each).
CACHED = 300_000
MARK = "▁"

#: Where the first tokenizer's splitting pattern always ends a piece, and where the second one's pieces always begin.
RESTART_A = re.compile(f"(?<=[A-Za-z])(?=[.,;:!?])|(?<=[^{SPACE}])(?=[{SPACE}])")
RESTART_B = re.compile("(?<=[^ ])(?= )")

Token = tuple[int, int]  # id, first byte


class Fragment(NamedTuple):
    """``closed``: (rendered groups, link keys). ``tail`` is None where no place begins tokens of both; all is ``head`` then."""

    head: tuple[list[Token], list[Token]]
    closed: list[tuple[str, bytes]]
    tail: tuple[list[Token], list[Token]] | None


EMPTY = Fragment(([], []), [], None)


def close(a: list[Token], b: list[Token]) -> tuple[str, bytes]:
    """One group as text, and a key (first id in the high, second id in the low 16 bits) per overlapping pair."""
    i = j = 0
    keys = []
    while True:
        keys.append(a[i][0] << 16 | b[j][0])
        at = a[i + 1][1] if i + 1 < len(a) else None
        bt = b[j + 1][1] if j + 1 < len(b) else None
        if at is None and bt is None:
            break
        if bt is None or (at is not None and at < bt):
            i += 1
        else:
            j += 1
    text = ",".join(str(t) for t, _ in a) + "|" + ",".join(str(t) for t, _ in b)
    return text, np.array(keys, "<u4").tobytes()


def fragment(a: list[Token], b: list[Token]) -> Fragment:
    """The fragment of a range from the tokens that begin in it."""
    begins = {at for _, at in b}
    cuts = [at for _, at in a if at in begins]
    if not cuts:
        return Fragment((a, b), [], None)
    parts = []
    for tokens in (a, b):
        places = [at for _, at in tokens]
        ends = np.searchsorted(places, cuts).tolist()
        parts.append([tokens[s:e] for s, e in zip([0, *ends], [*ends, len(tokens)])])
    groups = list(zip(*parts))
    return Fragment(groups[0], _joined([close(*g) for g in groups[1:-1]]), groups[-1])


def _joined(groups: list[tuple[str, bytes]]) -> list[tuple[str, bytes]]:
    return [(";".join(t for t, _ in groups), b"".join(k for _, k in groups))] if groups else []


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. ``EMPTY`` is neutral. What stands open between them is looked at again, since a
    token may begin in the first range where the other tokenizer's token of the second range begins."""
    open_a, open_b = x.head if x.tail is None else x.tail
    between = fragment(open_a + y.head[0], open_b + y.head[1])
    head = between.head if x.tail is None else x.head
    closed = x.closed + between.closed
    if y.tail is None:
        return Fragment(head, closed, between.tail)
    if between.tail is not None:
        closed = closed + [close(*between.tail)]
    return Fragment(head, closed + y.closed, y.tail)


def byte_level_bytes(token: str) -> bytes:
    """A byte-level vocabulary writes each byte as one printable character (fixed rule)."""
    return bytes(BYTE_OF[c] for c in token)


def _byte_characters() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE_OF = _byte_characters()


class Pair:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.coder = ChunkCoder(a_path, limit=CACHED)
        self.coder.added = []
        self.a = self.coder.tokenizer
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if max(self.a.get_vocab_size(), self.b.get_piece_size()) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 tokens are not supported")
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [n.encode() if n in special else byte_level_bytes(n) for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        # parts of a text may only be encoded alone if the splitting pattern is the known one and no piece reaches into a space
        split = json.loads(self.a.to_str())
        self.known = split["normalizer"] is None and split["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuttable = self.known and not any(
            MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.lead = len(self.b.encode("\n"))
        words = [[f"{i}{end}" for i in range(n) for end in ends]
                 for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))]
        self.words, self.b_words = words[0] + words[1], len(words[0])

    def encode_a(self, text: str) -> np.ndarray:
        return np.frombuffer(self.coder.whole(text) if self.known else self.coder.encode([text])[0], "<u4")

    def encode_b(self, part: str) -> np.ndarray:
        """Ids of a part of a text as it is: the space the library adds stands for a leading one, or a line end is put before the
        part (also before a lone space, as nothing is added to an empty text)."""
        if part[0] == " " and part != " ":
            return np.array(self.b.encode(part[1:]), "<u4")
        return np.array(self.b.encode("\n" + part)[self.lead:], "<u4")

    def equal(self, a: np.ndarray, a_text: str, b: np.ndarray, b_text: str) -> bool:
        """Whether the tokens' bytes are those of the texts."""
        return (b"".join(map(self.a_bytes.__getitem__, a.tolist())) == a_text.encode()
                and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == b_text.encode())

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both tokenizers' ids of texts that begin with a space; None where the bytes differ."""
        out = []
        for text, b in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1)):
            pair = self.encode_a(text), np.array(b, "<u4")
            out.append(pair if self.equal(pair[0], text, pair[1], text) else None)
        return out

    def aligned(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, groups as text, link keys."""
        a, b = (np.concatenate(side) for side in zip(*found))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_at, b_at = a_end - self.a_len[a], b_end - self.b_len[b]
        place = np.searchsorted(b_at, a_at)
        a_cut = b_at[np.minimum(place, len(b) - 1)] == a_at
        b_cut = np.zeros(len(b), bool)
        b_cut[place[a_cut]] = True
        inner = np.flatnonzero(~b_cut)
        a_keys = a << 16 | b[place - ~a_cut]
        b_keys = a[np.searchsorted(a_at, b_at[inner]) - 1] << 16 | b[inner]
        # where each token stands in the text of the groups
        a_first, b_first = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
        a_group, b_group = np.cumsum(a_cut) - 1, np.cumsum(b_cut) - 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + b_first[a_group]] = 2 * a.astype(np.int64) + np.append(a_cut[1:], True)
        codes[np.arange(len(b)) + np.append(a_first[1:], len(a))[b_group]] = (
            self.b_words + 2 * b.astype(np.int64) + np.append(b_cut[1:], True))
        sizes = np.cumsum([(0, 0), *((len(x), len(y)) for x, y in found)], axis=0)
        inner_at = np.searchsorted(inner, sizes[:, 1])
        groups = np.append(0, np.cumsum(a_cut))[sizes[:, 0]]
        out = []
        for k, ((i, j), (i2, j2)) in enumerate(zip(sizes[:-1].tolist(), sizes[1:].tolist())):
            text = "".join(map(self.words.__getitem__, codes[i + j:i2 + j2].tolist()))[:-1]
            keys = a_keys[i:i2].tobytes() + b_keys[inner_at[k]:inner_at[k + 1]].tobytes()
            out.append((i2 - i, j2 - j, int(groups[k + 1] - groups[k]), text, keys))
        return out


#: One pair of tokenizers per worker process.
PAIRS: dict[tuple[str, str], Pair] = {}


def worker_pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in PAIRS:
        PAIRS.clear()
        PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return PAIRS[a_path, b_path]


def chunk_starts(text: str, size: int, restart: re.Pattern) -> Iterator[int]:
    """Per chunk of ``size`` characters, where the share of a tokenizer begins: its first restart from there on, or where the next
    share begins if the chunk has none."""
    at = 0
    for low in range(0, len(text), size):
        if low and at <= low:
            found = restart.search(text, low)
            at = found.start() if found else len(text)
        yield at


def chunks(text: str, size: int, cuttable: bool) -> Iterator[tuple[str, int, str, int]]:
    """(first share, its first byte, second share, its first byte) of the chunks of a text."""
    if not cuttable:
        yield text, 0, text, 0
        return
    starts = list(zip(chunk_starts(text, size, RESTART_A), chunk_starts(text, size, RESTART_B))) + [(len(text),) * 2]
    a_byte = b_byte = 0
    for (a, b), (a2, b2) in zip(starts, starts[1:]):
        yield text[a:a2], a_byte, text[b:b2], b_byte
        a_byte += len(text[a:a2].encode())
        b_byte += len(text[b:b2].encode())


PASS_SCHEMA = ("key long, no long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, a_text string, "
               "a_at long, b_text string, b_at long")


def encode_documents(source: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """One row per short document (``no`` is -1, all of its results but the counts), and one per chunk of a longer one."""
    names = ["doc_id", *(c.split()[0] for c in PASS_SCHEMA.split(", "))]

    def run(blocks):
        pair = worker_pair(a_path, b_path)
        number = TaskContext.get().partitionId() << 40
        for ids, block in blocks:
            rows, block = [], [" " + t if t else "" for t in block]
            short = iter(pair.ids([t for t in block if 0 < len(t) <= chunk]))
            found = []
            for doc, text in zip(ids, block):
                number += 1
                if len(text) <= chunk:
                    got = next(short) if text else None
                    rows.append((doc, number, -1, *((0, 0, 0, "", b"") if got is None else (None,) * 5), None, 0, None, 0))
                    found += [] if got is None else [got]
                    continue
                for no, parts in enumerate(chunks(text, chunk, pair.cuttable)):
                    rows.append((doc, number, no, 0, 0, 0, "", b"", *parts))
            results = iter(pair.aligned(found) if found else [])
            for k, row in enumerate(rows):
                if row[3] is None:
                    n_a, n_b, n_groups, groups, keys = next(results)
                    rows[k] = (*row[:3], n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest(), keys, *row[8:])
            yield dict(zip(names, map(list, zip(*rows))))

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, run, f"doc_id {kind}, {PASS_SCHEMA}")


def chunk_fragments(cut: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows key, no, first, equal, n_a, n_b, open (the fragment without its closed groups), place, groups, links of the chunks."""
    names = ("key", "no", "first", "equal", "n_a", "n_b", "open", "place", "groups", "links")

    def tokens(ids, lengths, at):
        sizes = lengths[ids]
        return list(zip(ids.tolist(), (at + np.cumsum(sizes) - sizes).tolist()))

    def run(blocks):
        pair = worker_pair(a_path, b_path)
        for block in blocks:
            out = {k: [] for k in names}
            for key, no, a_text, a_at, b_text, b_at in zip(*block):
                none = np.zeros(0, "<u4")
                a = pair.encode_a(a_text) if a_text else none
                b = pair.encode_b(b_text) if b_text else none
                equal = pair.equal(a, a_text, b, b_text)
                made = fragment(tokens(a, pair.a_len, a_at), tokens(b, pair.b_len, b_at)) if equal else EMPTY
                groups, keys = made.closed[0] if made.closed else (None, None)
                for name, x in zip(names, (key, no, no, equal, len(a), len(b), pickle.dumps(made._replace(closed=[])), 2 * no,
                                           groups, keys)):
                    out[name].append(x)
            yield out

    rows = cut.select("key", "no", "a_text", "a_at", "b_text", "b_at").repartition("key", "no")
    return map_texts(rows, run, FRAGMENT_SCHEMA, text_at=2)


FRAGMENT_SCHEMA = ("key long, no long, first long, equal boolean, n_a long, n_b long, open binary, place long, groups string, "
                   "links binary")


def composed(level: DataFrame, last: bool) -> DataFrame:
    """One level of the tree: up to ``FAN`` neighbouring fragments become one, and the groups closed between them rows of their own
    (``open`` null). The root closes its open suffix."""
    schema = "key long, no long, first long, open binary, place long, groups string, links binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        key, parent, first = int(group["key"].iloc[0]), int(group["no"].iloc[0]) // FAN, int(group["first"].iloc[0])
        total, rows = EMPTY, []
        for begin, data in zip(group["first"], group["open"]):
            total = compose(total, pickle.loads(data))
            rows += [(key, parent, first, None, 2 * int(begin) - 1, *c) for c in total.closed]
            total = total._replace(closed=[])
        if last and total.tail is not None:
            rows.append((key, parent, first, None, 1 << 40, *close(*total.tail)))
        rows.append((key, parent, first, pickle.dumps(total), None, None, None))
        return pd.DataFrame(rows, columns=names).astype({"place": "Int64"})

    return level.groupBy("key", F.expr(f"no div {FAN}").alias("parent")).applyInPandas(fold, schema)


def reduce_fragments(pieces: DataFrame) -> DataFrame:
    """The closed groups of chunked documents: key, place, groups, links, each text of ``pieces`` reduced in a tree."""
    most = pieces.agg(F.max("no")).first()[0]
    level, closed = pieces.select("key", "no", "first", "open"), pieces.select("key", "place", "groups", "links")
    while most is not None:
        last = most < FAN
        step = staged(composed(level, last), "fragments")
        closed = closed.unionByName(step.select("key", "place", "groups", "links"))
        level = step.filter("open is not null").select("key", "no", "first", "open")
        most = None if last else most // FAN
    return closed.filter("groups is not null")


def digested(closed: DataFrame) -> DataFrame:
    """key, n_groups, groups_sha256 of the rows of ``reduce_fragments``, read in order; a task holds one row's groups."""
    rows = closed.select("key", "place", "groups").repartition("key").sortWithinPartitions("key", "place")
    names = ("key", "n_groups", "groups_sha256")

    def run(blocks):
        at, sha, n = None, None, 0
        for keys, _, block in blocks:
            out = {k: [] for k in names}
            for key, groups in zip(keys, block):
                if key != at:
                    if at is not None:
                        for name, x in zip(names, (at, n, sha.hexdigest())):
                            out[name].append(x)
                    at, sha, n = key, hashlib.sha256(), 0
                sha.update(((";" if n else "") + groups).encode())
                n += groups.count(";") + 1
            yield out
        yield {"key": [], "n_groups": [], "groups_sha256": []} if at is None else dict(
            zip(names, ([at], [n], [sha.hexdigest()])))

    return map_texts(rows, run, "key long, n_groups long, groups_sha256 string", text_at=2)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n: how many links hold each pair of ids; summed per task before the shuffle."""

    def run(blocks: Iterable):
        kept, held = [], 0

        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in kept])).astype("i8")

        for (block,) in blocks:
            keys = np.frombuffer(b"".join(k for k in block if k), "<u4")
            if len(keys):
                kept.append(np.unique(keys, return_counts=True))
                held += len(kept[-1][0])
            if held > 4_000_000:
                kept = [merged()]
                held = len(kept[0][0])
                if held > 2_000_000:
                    yield {"pair": kept[0][0].astype("i8"), "n": kept[0][1]}
                    kept, held = [], 0
        keys, n = merged() if kept else ([], [])
        yield {"pair": np.asarray(keys, "i8"), "n": np.asarray(n, "i8")}

    found = map_texts(links.select("links"), run, "pair long, n long", text_at=0)
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_pairs(counts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(pairs with counts of at least a power of two, the rest): the lowest such power that leaves at most ``size`` pairs."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["rows"] for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    cut, left = 64, size
    for p in sorted(sizes, reverse=True):
        left -= sizes[p]
        if left < 0:
            break
        cut = p
    return counts.filter(power >= cut), counts.filter(power < cut)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first tokenizer (a byte-level ``tokenizers`` file) encodes a space and the text, the second (a ``sentencepiece`` model that
    adds the space itself) the text; special strings are plain text. Texts that are null or empty, or whose tokens' bytes are
    not those of the space and the text, have zeros and an empty digest, and count for no pair. A link is a pair of overlapping tokens;
    the count of its id pair is taken over all documents, repeated rows each; ``n_best`` are links whose count is the highest of
    their second id, ties included. A null id stays null; other columns are ignored; an empty table gives an empty result.
    Texts of any length are encoded whole: a stretch in which a tokenizer cannot be restarted stays in one task.
    """
    source = texts(docs, id_col, text_col)
    first = staged(encode_documents(source, a_path, b_path, chunk), "encoded")
    short, cut = first.filter("no < 0"), first.filter("no >= 0")
    pieces = staged(chunk_fragments(cut, a_path, b_path), "chunks")
    facts = pieces.groupBy("key").agg(F.min("equal").alias("equal"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    good = facts.filter("equal").select("key", "n_a", "n_b")
    closed = staged(reduce_fragments(pieces).join(good.select("key"), "key", "left_semi"), "closed")
    long = cut.filter("no = 0").select("key", "doc_id").join(good, "key", "left").join(digested(closed), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    long = long.select("key", "doc_id", zero("n_a"), zero("n_b"), zero("n_groups"),
                       F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    links = short.select("key", "links").unionByName(closed.select("key", "links"))
    counts = staged(pair_counts(links), "pairs")
    per_b = counts.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("b")).agg(F.max("n").alias("n")).collect()
    most = np.zeros(1 << 16, "i8")
    most[[r["b"] for r in per_b]] = [r["n"] for r in per_b]
    frequent, rest = frequent_pairs(counts, table_size)
    table = frequent.orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (table["pair"].to_numpy().astype("<u4"), table["n"].to_numpy(), most))

    def score(blocks):
        pairs, n, most = shared.value
        for keys, block in blocks:
            out = {"key": keys, "n_links": [], "n_best": [], "count_sum": [], "missed": [], "times": []}
            for data in block:
                own = np.frombuffer(data or b"", "<u4")
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                got = n[at[hit]]
                missed, times = np.unique(own[~hit], return_counts=True)
                for name, x in zip(list(out)[1:], (len(own), int((got == most[own[hit] & 0xFFFF]).sum()), int(got.sum()),
                                                   missed.astype("i8").tolist(), times.tolist())):
                    out[name].append(x)
            yield out

    scored = map_texts(links, score, "key long, n_links long, n_best long, count_sum long, missed array<long>, "
                       "times array<long>")
    scored = staged(scored, "scored")
    top = docs.sparkSession.createDataFrame([(int(b), int(most[b])) for b in np.flatnonzero(most)], "b long, top long")
    lost = scored.select("key", F.explode(F.arrays_zip("missed", "times")).alias("m")).select(
        "key", F.col("m.missed").alias("pair"), F.col("m.times").alias("times")).join(rest, "pair")
    lost = lost.join(F.broadcast(top), F.col("pair").bitwiseAND(0xFFFF) == F.col("b")).select(
        "key", F.lit(0).cast("long").alias("n_links"), F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("n") * F.col("times")).alias("count_sum"))
    sums = scored.select("key", "n_links", "n_best", "count_sum").unionByName(lost)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    documents = short.select("key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").unionByName(long)
    both = documents.unionByName(sums, allowMissingColumns=True)
    total = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in columns],
                                    F.max("groups_sha256").alias("groups_sha256"))
    return total.select("doc_id", *[zero(c) for c in columns], "groups_sha256")
