"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each result to the shared folder as Parquet and
reads it back. All stages but the last return the columns of ``docs``. Null texts count as empty throughout; every row is judged
by its own text, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import read, staged
from tallyward.llm.decontaminate import find_leaks
from tallyward.llm.minhash_dedup import near_duplicates
from tallyward.llm.packing import pack_documents
from tallyward.llm.pii import find_personal_data
from tallyward.llm.queries import tokenizer_path
from tallyward.llm.toxicity import keep_clean

#: Numbers per bitmap of ``marked``: those of Spark's bitmap functions.
MARKS = 32_768
#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return keep_clean(docs, read(spark, sf_dir, "labels"))


def keyed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own per row, stored so that it stays the same, and the number's column."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), label), key


def marked(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows whose number, not below 0, is in the one column of ``kept``, with one bit per number instead of a join, so that no text
    is shuffled. Broadcast are bitmaps of 4 KB: one per 32,768 rows, and at most one more per task that numbered them."""
    number = F.col(kept.columns[0])
    maps = staged(kept.groupBy(F.floor(number / MARKS).alias("group")).agg(
        F.bitmap_construct_agg(F.pmod(number, F.lit(MARKS))).alias("bits")), "marks")
    place = F.pmod(rows[key], F.lit(MARKS)).cast("int")
    byte = F.conv(F.hex(F.substring(maps["bits"], F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), F.floor(rows[key] / MARKS) == maps["group"])
    return found.filter(F.getbit(byte, place % 8) == 1).select(*[rows[f"`{c}`"] for c in rows.columns])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate rows stays: that of the smallest id, null last, and of rows that tie on the id the
    first as read. Rows are compared by their texts alone, so different texts under one id are judged apart, and
    rows without an id like any others."""
    rows, key = keyed(docs, "rows")
    groups = near_duplicates(rows, id_col=key).select(F.col("doc_id").alias("k"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(key).alias("k"))
    first = rows.select(key, order.alias("o")).join(groups, F.col(key) == F.col("k")).groupBy("class_id").agg(F.min("o").alias("o"))
    return marked(rows, key, first.select(F.col("o.k"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each judged by its own text, with or without an id."""
    rows, key = keyed(docs, "rows")
    leaks = staged(find_leaks(rows, read(spark, sf_dir, "benchmark"), id_col=key), "leaks")
    gone = leaks.select(F.col("doc_id").alias("gone_key")).distinct()
    return rows.join(gone, rows[key] == gone["gone_key"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are replaced by their sanitised form; ``n_chars`` follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = {c: f"kept_{i}" for i, c in enumerate(others)}
    found = find_personal_data(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in kept.items()]),
                               keep=tuple(kept.values()))
    cells = {"doc_id": F.col("doc_id"), "text": F.col("clean_text"), **{c: F.col(k) for c, k in kept.items()}}
    if "n_chars" in cells:
        cells["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[cells[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate_groups), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
