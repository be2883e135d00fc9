"""Token alignment against plain definitions."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

from tallyward.llm import alignment  # noqa: E402
from tallyward.llm.alignment import EMPTY, Pair, align_tokens, close, compose, fragment  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return Pair(A, B)


def whole(pair, text):
    """Groups of one text by the libraries: [(a ids, b ids)] and links [(a id, b id)]; None without tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    sides = []
    for ids, of in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.a_bytes), (pair.b.encode(text), pair.b_bytes)):
        if b"".join(of[i] for i in ids) != data:
            return None
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(of[i])))
            at += len(of[i])
        sides.append(spans)
    ends = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
    groups = [([], []) for _ in ends]
    for k, side in enumerate(sides):
        for i, _, e in side:
            groups[bisect_left(ends, e)][k].append(i)
    links, j = [], 0
    b = sides[1]
    for i, s, e in sides[0]:
        while j and b[j][1] > s:
            j -= 1
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    return groups, links


def expected(pair, rows):
    found = [(d, whole(pair, t)) for d, t in rows]
    counts = Counter(x for _, f in found if f for x in f[1])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = f
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


ALPHABET = ["a", "the", "Straße", "naïve", "é", "漢字", "🙂", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " ", " ", ".",
            "...", "don't", "I'll", "12345", "x" * 40, "_", "(", ")", "</s>", "<unk>", "<|endoftext|>", "\x00", "ΑΒΓ", ",", ";", "-"]


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) + (" " if rng.random() < 0.5 else "") for _ in range(n))


def test_parts_encode_as_the_whole_text(pair):
    """The shares of all chunks of a text together, and the cached encoding of whole texts, are what the libraries give."""
    assert pair.cuttable
    rng = random.Random(2)
    for _ in range(800):
        text = " " + random_text(rng, rng.randrange(1, 25))
        a, b = pair.a.encode(text, add_special_tokens=False).ids, pair.b.encode(text[1:])
        assert pair.encode_a(text).tolist() == a, repr(text)
        parts = list(alignment.chunks(text, rng.randrange(1, 30), True))
        assert "".join(p[0] for p in parts) == "".join(p[2] for p in parts) == text
        assert [i for p in parts if p[0] for i in pair.encode_a(p[0]).tolist()] == a, repr(text)
        assert [i for p in parts if p[2] for i in pair.encode_b(p[2]).tolist()] == b, repr(text)


def test_fragments_are_a_monoid(pair):
    rng = random.Random(4)
    for _ in range(60):
        text = " " + random_text(rng, 40)
        sides = []
        for ids, sizes in ((pair.a.encode(text, add_special_tokens=False).ids, pair.a_len), (pair.b.encode(text[1:]), pair.b_len)):
            at, tokens = 0, []
            for i in ids:
                tokens.append((i, at))
                at += int(sizes[i])
            sides.append(tokens)
        cuts = [sorted(rng.randrange(at) for _ in range(6)) for _ in sides]  # each side is cut elsewhere
        ranges = list(zip(*(zip([0, *c], [*c, at]) for c in cuts)))
        parts = [fragment(*([t for t in side if lo <= t[1] < hi] for side, (lo, hi) in zip(sides, r))) for r in ranges]
        text_of = lambda f: (f.head, ";".join(t for t, _ in f.closed), b"".join(k for _, k in f.closed), f.tail)
        total = fragment(*sides)
        left = EMPTY
        for p in parts:
            left = compose(left, p)
        right = EMPTY
        for p in reversed(parts):
            right = compose(p, right)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k:k + 2] = [compose(parts[k], parts[k + 1])]
        assert text_of(total) == text_of(left) == text_of(right) == text_of(parts[0])


@pytest.mark.parametrize("chunk,table_size", [(65_536, 1 << 20), (40, 50), (7, 0)])
def test_by_definition(spark, frame, pair, chunk, table_size):
    rng = random.Random(8)
    rows = [(i, random_text(rng, rng.randrange(1, 60))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " "), (73, "a▁b"), (74, "same text here"), (74, "same text here"), (None, "no id"),
             (75, "z" * 900), (76, "漢字" * 300), (77, "word " * 700), (78, "a " * 50 + "▁" + " b" * 50)]
    got = align_tokens(frame(rows), A, B, chunk=chunk, table_size=table_size)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert Counter(map(tuple, got.collect())) == expected(pair, rows)


def test_very_long_text_and_empty_table(awkward, empty, pair):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert Counter(map(tuple, align_tokens(awkward, A, B, chunk=10_000).collect())) == expected(pair, rows)
    assert align_tokens(empty, A, B).count() == 0


def test_close():
    assert close([(1, 0), (2, 3)], [(7, 0), (8, 2), (9, 4)])[0] == "1,2|7,8,9"
