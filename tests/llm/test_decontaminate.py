import random
from collections import Counter

import numpy as np
import pytest

from tallyward.llm.decontaminate import bag_overlap, bags, common_subsequence, find_leaks, shared_words, strided, word_places

VOCABULARY = [f"w{k}" for k in range(3000)]
COMMON = ["the", "of", "and", "to"]


def passage(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(VOCABULARY) for _ in range(n))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        assert common_subsequence(a, b) == plain_lcs(a, b)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    items = [(k, passage(rng, rng.choice([15, 30, 60, 150]))) for k in range(30)]
    docs, leaks = [], set()
    for d in range(240):
        words = passage(rng, rng.choice([40, 300, 1500])).split()
        if d % 6 == 0:
            item, text = items[d // 6 % 30]
            kind = d % 4
            tokens = text.split()
            if kind == 0:  # case and marks
                tokens = [t.upper() + "," for t in tokens]
            elif kind == 2:  # a fifth of the words replaced, not at the end
                for at in rng.sample(range(len(tokens) - 6), len(tokens) // 5):
                    tokens[at] = rng.choice(VOCABULARY)
            at = rng.randrange(len(words))
            words[at:at] = tokens
            leaks.add((d, item))
        docs.append((d, " ".join(words)))
    return docs, items, leaks


def test_planted_items_and_no_others(spark, frame, corpus):
    docs, items, leaks = corpus
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = find_leaks(frame(docs), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaks and len(got) == len(leaks)
    assert all(r["cover"] >= 0.6 or r["answer"] >= 0.8 for r in got)
    in_blocks = find_leaks(frame(docs), benchmark, block_items=7).collect()
    assert {(r["doc_id"], r["item_id"]) for r in in_blocks} == leaks


def test_awkward_rows(spark, awkward, empty):
    schema = "item_id long, text string"
    text = "one two three four five six"
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, text), (5, text), (6, text), (6, text)], schema)
    got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(awkward, items).collect())
    assert got == [(4, 5), (4, 6)]
    assert find_leaks(empty, items).count() == 0
    assert find_leaks(awkward, items.limit(0)).count() == 0


def test_repeated_paraphrase_and_one_document(spark, frame):
    rng = random.Random(4)
    item = [f"q{k}" for k in range(20)]
    leak = item.copy()
    for at in (3, 7, 11, 14):
        leak[at] = f"r{at}"
    hot = " ".join(passage(rng, 30).split() + leak + passage(rng, 30).split())
    docs = [(k, hot if k % 3 == 0 else passage(rng, 90)) for k in range(600)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    results = []
    for parts in (1, 4, 100, 200):  # the result does not depend on how rows are dealt to tasks
        rows = find_leaks(frame(docs).repartition(parts), benchmark).collect()
        results.append(sorted((r["doc_id"], r["item_id"], round(r["cosine"], 5), r["cover"], r["answer"], r["kind"]) for r in rows))
        assert {r["doc_id"] for r in rows} == {k for k in range(600) if k % 3 == 0}
    assert all(r == results[0] for r in results)
    assert [r["doc_id"] for r in find_leaks(frame(docs[:1]), benchmark).collect()] == [0]


def test_copies_do_not_depend_on_the_latent_space(spark, frame):
    rng = random.Random(5)
    items = [(k, passage(rng, rng.randrange(16, 60))) for k in range(1024)]
    docs = [(k, f"{passage(rng, rng.randrange(0, 90))} {items[k % 1024][1]} {passage(rng, 60)}") for k in range(1200)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for cosine in (0.4, 1.1):  # no cosine reaches 1.1
        got = {(r["doc_id"], r["item_id"]) for r in find_leaks(frame(docs), benchmark, cosine=cosine).collect()}
        assert {(k, k % 1024) for k in range(1200)} <= got


def test_shared_words_by_brute_force():
    rng = np.random.default_rng(6)
    queries = [np.unique(rng.integers(1, 40, 9)) for _ in range(30)]
    texts = [rng.integers(1, 40, n) for n in (0, 5, 31, 32, 33, 64, 200)]
    flat, owner = np.concatenate(queries), np.repeat(np.arange(30), [len(q) for q in queries])
    order = np.argsort(flat, kind="stable")
    postings = np.searchsorted(flat[order], np.arange(41)), owner[order]
    ids, stride, first, n = strided([t.astype(np.uint16).tobytes() for t in texts], np.ones(40))
    needed = rng.integers(4, 16, 30)
    want, base = set(), 0
    for t in texts:
        parts = [set(t[at:at + 32].tolist()) for at in range(0, max(1, len(t)), 32)]
        for k in range(len(parts)):
            for q, words in enumerate(queries):
                if sum(len(p & set(words.tolist())) for p in parts[k:k + 2]) >= needed[q]:
                    want.add((base + k, q))
        base += len(parts)
    for at_once in (1, 90, 4_000_000):
        p, q = shared_words(ids, stride, first, postings, needed, at_once)
        assert base == n and want and set(zip(p.tolist(), q.tolist())) == want and (np.diff(p) >= 0).all()


def test_bag_overlap_bounds_the_common_subsequence():
    """Words that come again around a place count no more often than the item has them."""
    rng = np.random.default_rng(8)
    items = [rng.integers(1, 30, n).tolist() for n in (1, 4, 9, 25, 9)]
    members = np.zeros((len(items), 30), bool)
    for i, t in enumerate(items):
        members[i, t] = True
    ids = rng.integers(1, 30, 500).astype(np.uint16)
    left = rng.integers(0, 500, 200)
    right, item = np.minimum(left + rng.integers(0, 90, 200), 500), rng.integers(0, len(items), 200)
    regions = [ids[a:b].tolist() for a, b in zip(left, right)]
    want = [sum((Counter(r) & Counter(items[i])).values()) for r, i in zip(regions, item)]
    for part in (3, 50_000):
        assert bag_overlap(ids, left, right, item, bags(items), members, part).tolist() == want
    assert all(plain_lcs(items[i], r) <= n for r, i, n in zip(regions, item, want))
    assert any(n < members[i][r].sum() for r, i, n in zip(regions, item, want))
    assert all(common_subsequence(items[i], r, word_places(items[i])) == plain_lcs(items[i], r) for r, i in zip(regions, item))
