import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyward.llm.components import connected_components
from tallyward.llm.embedding_dedup import near_duplicate_vectors
from tallyward.llm.minhash_dedup import near_duplicates
from tallyward.llm.shingles import WORD, ConsistentSampler, ShingleEncoder, weighted_jaccard, word_weights, words


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)]
    links += [(1000, x) for x in range(1001, 1300)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = components_of(nodes, links)
    assert len(got) == len(nodes) and {r["node"]: r["component"] for r in got} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_by_brute_force(rows, threshold):
    good = [(i, np.array(v, float), label) for i, v, label in rows
            if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = set()
    for k, (i, v, label) in enumerate(good):
        for j, w, other in good[:k]:
            if i != j and label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links |= {(i, j), (j, i)}
    part = components_of([r[0] for r in rows if r[0] is not None], links)
    n = Counter(a for a, _ in links)
    return {(i, n[i], part[i], part[i] == i) for i, _, _ in rows if i is not None}


@pytest.mark.parametrize("dims,tile", [(24, 8), (3, 1000), (1, 5), (40, 64)])
def test_vectors_against_brute_force(spark, dims, tile):
    rng = np.random.default_rng(dims)
    rows = []
    for k in range(220):
        base = rows[rng.integers(len(rows))][1] if rows and k % 2 else rng.normal(size=dims).tolist()
        noise = rng.normal(size=dims) * rng.choice([0, 0.02, 0.05])
        rows.append((1000 - k, [float(np.float32(x)) for x in np.array(base) + noise], int(rng.integers(3))))
    rows += [(1, rows[0][1], rows[0][2]), (2, [-x for x in rows[0][1]], rows[0][2]), (3, [2 * x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, "n", 1.5) for r in rows],
                               "vec_id long, embedding array<double>, label int, rep string, copies double")
    got = {tuple(r) for r in near_duplicate_vectors(df, 0.98, tile=tile).collect()}
    assert got == vectors_by_brute_force(rows, 0.98)


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1),
            (6, [1.0, float("inf")], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1),
            (11, [3.0, 0.0], 1), (11, [3.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in near_duplicate_vectors(df).collect())
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 8)] + [(9, 1, 9, True), (10, 0, 10, True)] + [(11, 1, 9, False)] * 2
    assert got == sorted(want)
    none = spark.createDataFrame([(None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in near_duplicate_vectors(none).collect()] == [(None, 0, None, False)]
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def encoder_for(texts):
    seen = Counter(w for t in texts for w in set(words(t)))
    n = len(texts)
    return ShingleEncoder({w: 1 + math.log((1 + n) / (1 + c)) for w, c in seen.items()}, 1 + math.log((1 + n) / 2))


def classes_by_brute_force(docs, threshold=0.8):
    encoder = encoder_for([t or "" for _, t in docs])
    sets = [(i, encoder.features(words(t or ""))) for i, t in docs if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and weighted_jaccard(x, y) >= threshold]
    return components_of({i for i, _ in sets}, links)


def edited(tokens, rng, edits):
    out = list(tokens)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_near_duplicates_against_brute_force(frame):
    rng = random.Random(4)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        for k in range(rng.choice([1, 4, 12])):
            docs.append((len(docs) * 3 + 5, " ".join(edited(base, rng, rng.randrange(0, max(1, len(base) // 20) + 1)))))
    docs += [(1, docs[0][1].upper()), (2, docs[5][1] + " ."), (0, "")]
    got = near_duplicates(frame(docs)).collect()
    want = classes_by_brute_force(docs)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got) and len(got) == len(docs)


def test_a_large_group_is_whole(frame, monkeypatch):
    """Members that miss the smallest one's similarity still join through others; small blocks exercise the dealing."""
    import tallyward.llm.minhash_dedup as module

    monkeypatch.setattr(module, "BLOCK", 7)
    monkeypatch.setattr(module, "MEMBERS", 20)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    docs = [(k, " ".join(edited(base, rng, rng.randrange(0, 4)))) for k in range(150)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(frame(docs)).collect()}
    assert got == classes_by_brute_force(docs)


def test_weights_of_more_words_than_65536(spark, frame):
    """Rare words keep their own weight whatever the number of words; frequencies do not depend on the partitions."""
    docs = [(k, " ".join(f"b{j}" for j in range(10)) + " " + " ".join(f"u{k}x{j}" for j in range(60))) for k in range(1200)]
    docs += [(2000 + k, f"twice thrice{k // 3}") for k in range(6)]
    source = frame(docs).select("doc_id", "text")
    seen = Counter(w for _, t in docs for w in set(words(t)))
    assert len(seen) > 72_000
    for parts in (1, 7):
        weights = word_weights(source.repartition(parts))
        off = [w for w, n in seen.items() if weights.frequency(w) != n]
        assert len(off) < 0.01 * len(seen) and all(weights.frequency(w) >= n for w, n in seen.items())
        assert abs(weights.get("b0") - (1 + math.log(1207 / 1201))) < 1e-9


def test_boilerplate_does_not_merge_different_documents(frame):
    """Documents that share 60 of 80 words stay apart when the others are rare, however many words there are."""
    base = " ".join(f"b{j}" for j in range(60))
    docs = [(k, base + " " + " ".join(f"u{k}x{j}" for j in range(20))) for k in range(400)]
    assert all(r["kept"] for r in near_duplicates(frame(docs)).collect())


def test_near_duplicates_of_awkward_rows(awkward, empty):
    got = [tuple(r) for r in near_duplicates(awkward).collect()]
    assert Counter(got) == Counter([(i, i, True) for i in (1, 2, 3, 5, 6, 7, 8, 9)] + [(4, 4, True)] * 2 + [(None, None, True)])
    assert near_duplicates(empty).count() == 0


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(1, 1 << 62, 400).astype(np.uint64))
    a, b = rng.gamma(2, 1, 400), rng.gamma(2, 1, 400)
    sampler = ConsistentSampler(3000)
    share = (sampler.sample(keys[:300], a[:300]) == sampler.sample(keys[100:], b[100:])).mean()
    assert abs(share - weighted_jaccard((keys[:300], a[:300]), (keys[100:], b[100:]))) < 0.04
    assert (sampler.sample(keys, a) == sampler.sample(keys, a, part=37)).all()


def test_words_and_features_of_texts_in_any_order():
    """Words are runs of word characters, with and without other letters; new words meet known ones in the index."""
    texts = ["A-b_c 9\t\x1cZ\x7f", "".join(map(chr, range(128))), "É-b ß", "", "a b a c a b", "q a q b q"]
    for t in texts:
        assert words(t) == WORD.findall(t.lower())
    shared, weight = ShingleEncoder({"a": 2.0}, 3.0, size=2), {"a": 2.0}
    for t in texts * 2:
        apart = ShingleEncoder(weight, 3.0, size=2)
        for x, y in zip(shared.features(words(t)), apart.features(words(t))):
            assert (x == y).all()
    assert sorted(shared.index) == sorted({w for t in texts for w in words(t)})
