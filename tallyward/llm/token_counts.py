"""Token counts by a map-side two-tier lookup.

First pass: each task counts the pre-token chunks of its texts and hands on at most ``candidates`` of the
most frequent; their sums give the ``table_size`` most frequent chunks of the corpus. The driver encodes
those once and broadcasts chunk -> number of tokens (``table_size`` bounds it, whatever the input). Second
pass: each task looks chunks up in that table, then in its own cache, and encodes what both lack. No text
and no chunk list is shuffled; the counts are exact because the table only saves work.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_texts, most_frequent, staged, texts
from tallyward.llm.pretokens import CHUNKS, KEEP_CHARS, ChunkCoder, worker_coder

TABLE_SIZE = 16_384
CANDIDATES = 16_384
#: A task's counter is cut back to its most frequent half beyond so many entries. This can only change
#: which chunks are looked up in the first tier.
COUNTER_SIZE = 400_000


def frequent_chunks(docs: DataFrame, candidates: int = CANDIDATES, table_size: int = TABLE_SIZE) -> DataFrame:
    """The most frequent chunks of all texts, as (chunk, n): all that occur as often as the last that fits into
    ``table_size``."""

    def count(blocks):
        seen: Counter = Counter()
        for _, block in blocks:
            for t in block:
                seen.update(CHUNKS.findall(t))
            if len(seen) > COUNTER_SIZE:
                seen = Counter(dict(seen.most_common(COUNTER_SIZE // 2)))
        top = [x for x in seen.most_common(candidates) if len(x[0]) <= KEEP_CHARS]
        yield {"chunk": [c for c, _ in top], "n": [n for _, n in top]}

    found = map_texts(docs, count, "chunk string, n long")
    counts = staged(found.groupBy("chunk").agg(F.sum("n").alias("n")), "chunks")
    return most_frequent(counts, table_size)[0]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens as the tokenizer file's library gives them.

    Special strings inside texts become their single token, as by the library's default; nothing is added
    at either end. A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are
    counted each; other columns are ignored; an empty table gives an empty result. Texts are never cut.
    """
    source = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    frequent = [r["chunk"] for r in frequent_chunks(source, table_size=table_size).collect()]
    coder = ChunkCoder(tokenizer_path, as_length=True)
    run = uuid.uuid4().hex
    table = spark.sparkContext.broadcast(dict(zip(frequent, coder.encode(frequent))))

    def count(blocks):
        coder = worker_coder(tokenizer_path, run, table.value, as_length=True)
        for ids, block in blocks:
            yield {"doc_id": ids, "n_bytes": [len(t.encode()) for t in block],
                   "n_tokens": [coder.whole(t) for t in block]}

    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, count, f"doc_id {id_type}, n_bytes long, n_tokens long")


def over_limit(counts: DataFrame, limit: int = 512) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
