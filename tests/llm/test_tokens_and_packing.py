import random
import zlib
from array import array
from collections import defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyward.llm.packing import HarmonicBins, cuts, pack_documents  # noqa: E402
from tallyward.llm.pretokens import ChunkCoder, load_tokenizer  # noqa: E402
from tallyward.llm.token_counts import count_tokens, frequent_chunks, over_limit  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(text):
    return load_tokenizer(PATH).encode(text, add_special_tokens=False).ids


def test_chunks_give_the_librarys_ids():
    rng = random.Random(3)
    parts = ["ab", "Éa", "ő", "ß", "×", "_", ".", " ", "  ", "\n", "\r\n", "\t", "é", "1", "'s", "'", "<|endoftext|>", "<|",
             "　", "\xa0", "!", "\x1c", "\x85", "漢", "🙂", "́", " ", "Ⅷ", "½"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(4000)]
    texts += [f"a{chr(c)}{chr(c)}b {chr(c)} c" for c in range(0x3100)]
    want = [array("I", e.ids).tobytes() for e in load_tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    coder = ChunkCoder(PATH, limit=500)  # small enough to start the second tier afresh many times
    assert [coder.whole(t) for t in texts] == want


def test_counts_equal_the_librarys(spark, awkward):
    rows = over_limit(count_tokens(awkward, PATH), 512).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(library_ids(r["text"] or ""))) for r in awkward.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows], key=key) == sorted(want, key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


def test_first_tier_is_the_corpus_top(spark, frame):
    docs = frame([(i, "the cat the dog the" if i % 2 else "the bird") for i in range(20)]).select("doc_id", "text")
    top = [(r["chunk"], r["n"]) for r in frequent_chunks(docs, table_size=3).collect()]
    assert sorted(top) == [(" the", 20), ("the", 20)]  # the next three have equal counts


def test_counts_of_an_empty_table(empty):
    assert count_tokens(empty, PATH).count() == 0


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 1023, 1024, 1025, 5000])
def test_cuts_cover_a_document_once(n):
    pieces = cuts(n, 1024, 64)
    assert [s for s, _ in pieces] == [sum(length for _, length in pieces[:i]) for i in range(len(pieces))]
    assert sum(length for _, length in pieces) == n and all(0 < length <= 1024 for _, length in pieces)


def test_bins_of_a_class_hold_a_fixed_count():
    bins = HarmonicBins(1024)
    closed = [x for i in range(40) for x in bins.put((i, 0, 60), False)]  # class 17
    counts = defaultdict(int)
    for _, sequence, _ in closed:
        counts[sequence] += 1
    assert set(counts.values()) == {17}


def check_packing(rows, docs, capacity=1024):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for doc_id, text in docs:
        data = array("I", library_ids(text or "") + [0]).tobytes()
        own = [r for r in by_doc[doc_id] if r["doc_tokens"] == len(data) // 4]
        assert {r["start"] for r in own} == {s for s, _ in cuts(len(data) // 4, capacity, 64)}
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(data[4 * r["start"]:4 * (r["start"] + r["length"])])
    return padding


def test_packing_is_whole_and_gapless(awkward):
    rows = pack_documents(awkward, PATH).collect()
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check_packing(rows, docs)
    assert sum(r["length"] for r in rows) == sum(len(library_ids(t or "")) + 1 for _, t in docs)


def test_packing_wastes_little_and_repeats(spark, frame):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["thorn", "basil", "ochre", "lumen"], k=rng.randint(0, 900)))) for i in range(300)]
    source = frame(docs).repartition(2, "doc_id")
    rows = pack_documents(source, PATH).collect()
    padding = check_packing(rows, docs)
    assert padding <= 0.03 * sum(r["length"] for r in rows)
    assert sorted(rows) == sorted(pack_documents(source, PATH).collect())


def test_packing_keeps_ids(frame):
    row, = pack_documents(frame([(1, "hello there")]), PATH, keep_ids=True).collect()
    assert list(array("I", row["ids"])) == library_ids("hello there") + [0]


def test_packing_of_an_empty_table_and_bad_sizes(empty):
    assert pack_documents(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        pack_documents(empty, PATH, capacity=1000)
