"""Near-duplicate documents by improved consistent weighted sampling.

1. Word document frequencies over all texts give the weights; a shingle of five words weighs its count times
   the mean inverse document frequency of its words, which needs no table of shingles. Frequencies are kept for all
   words, in a table of fixed size by the words' hashes.
2. Texts with the same words are one class (its smallest id), found by a 128-bit digest. Each class gets
   ``bands * rows`` samples; two classes with weighted Jaccard similarity s share a band with
   probability 1 - (1 - s^rows)^bands (0.999 at 0.8).
3. In each band bucket every class is compared with the bucket's smallest class; links are verified by the
   exact weighted Jaccard similarity of the whole texts, and components are formed.
4. In buckets that still hold several components, every class outside the largest one is compared with all
   classes of other components, in blocks of classes, so no verified link between components is missed. No
   pairs are written out: a block keeps its classes' shingles and reads the bucket's texts one by one.

Centers and buckets with many members are dealt out by salt, so no task gets a whole hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import likely_rows, map_texts, staged, texts
from tallyward.llm.components import connected_components
from tallyward.llm.shingles import ConsistentSampler, ShingleEncoder, WordWeights, weighted_jaccard, word_weights, words

BANDS, ROWS = 10, 3
#: Pairs with fewer equal samples than this share are not verified. At similarity 0.8 a pair falls below it with
#: probability 0.003.
LEAST_EQUAL = 0.6
#: Classes whose shingles a block holds in memory, and members per salted group.
BLOCK, MEMBERS = 256, 1000


def sketches(source: DataFrame, idf: WordWeights, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, print, samples): digest of the words, and the samples; texts without words are left out."""
    spark = source.sparkSession
    table = spark.sparkContext.broadcast(idf)

    def sketch(blocks) -> Iterator[dict]:
        encoder, sampler = ShingleEncoder(table.value, size=size), ConsistentSampler(bands * rows)
        for ids, block in blocks:
            out: dict[str, list] = {"doc_id": [], "print": [], "samples": []}
            for i, t in zip(ids, block):
                tokens = words(t)
                if tokens and i is not None:
                    out["doc_id"].append(i)
                    out["print"].append(hashlib.blake2b(" ".join(tokens).encode(), digest_size=16).digest())
                    out["samples"].append(sampler.sample(*encoder.features(tokens)).tobytes())
            yield out

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, sketch, f"doc_id {kind}, print binary, samples binary")


def verified(groups: DataFrame, source: DataFrame, idf: WordWeights, size: int, threshold: float, bands: int,
             rows: int) -> DataFrame:
    """Links (a, b) between the kind 0 and kind 1 rows of each group.

    ``groups``: grp (string), kind, node, comp, outer (is it outside the largest component), band (-1: any), samples.
    A group's kind 0 rows come first and stay in memory; the caller bounds their number.
    """
    spark = source.sparkSession
    table = spark.sparkContext.broadcast(idf)
    needed = staged(groups.select("node").distinct(), "needed")
    rows_in = (groups.join(likely_rows(source, "doc_id", needed), F.col("node") == F.col("doc_id"))
               .repartition("grp").sortWithinPartitions("grp", "kind", "node")
               .select("grp", "kind", "node", "comp", "outer", "band", "samples", "text"))

    def compare(blocks) -> Iterator[dict]:
        encoder = ShingleEncoder(table.value, size=size)
        least = LEAST_EQUAL * bands * rows
        at = None
        heads: list = []
        for cols in blocks:
            out: dict[str, list] = {"a": [], "b": []}
            for grp, kind, node, comp, outer, band, samples, text in zip(*cols):
                if grp != at:
                    at, heads, stack, done = grp, [], None, set()
                own = np.frombuffer(samples, np.uint32)
                if kind == 0:
                    heads.append((node, comp, encoder.features(words(text)), own))
                    stack = None
                    continue
                if not heads:
                    continue
                if stack is None:
                    stack = np.stack([h[3] for h in heads])
                    comps = np.array([h[1] for h in heads])
                    nodes = np.array([h[0] for h in heads])
                equal = stack == own
                ok = (equal.sum(axis=1) >= least) & (comps != comp)
                if outer:  # both outside the largest component: once, from the smaller id
                    ok &= nodes < node
                if band >= 0:  # only in the first band that a pair shares
                    ok &= equal.reshape(len(stack), bands, rows).all(axis=2).argmax(axis=1) == band
                found = np.flatnonzero(ok)
                if len(found):
                    mine = encoder.features(words(text))
                    for k in found.tolist():
                        key = (heads[k][1], comp)
                        if key not in done and weighted_jaccard(heads[k][2], mine) >= threshold:
                            done.add(key)
                            out["a"].append(heads[k][0])
                            out["b"].append(node)
            yield out

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(rows_in, compare, f"a {kind}, b {kind}", text_at=7)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of its near-duplicate group), kept (the id is the class id).

    Two documents are linked when the weighted Jaccard similarity of their TF-IDF word shingles is at least
    ``threshold``; groups are the connected components. Words are runs of word characters of the lower-cased
    text; texts with equal words are copies. A text of fewer than ``size`` words is one shingle. Null and
    wordless texts are in no group and keep themselves; rows with a null id have a null class and are kept.
    Rows that share an id belong to one node. Other columns are ignored; an empty table gives an empty result.
    """
    source = texts(docs, id_col, text_col)
    settings = word_weights(source), size
    sketch = staged(sketches(source, *settings, bands, rows), "sketches")
    classes = staged(sketch.groupBy("print").agg(F.min("doc_id").alias("node"), F.min("samples").alias("samples")),
                     "classes")
    width = 8 * rows
    banded = staged(classes.select("node", "samples", F.posexplode(F.array(*[
        F.xxhash64(F.substring(F.hex("samples"), k * width + 1, width)) for k in range(bands)])).alias("band", "key")),
        "bands")
    buckets = banded.groupBy("band", "key").agg(F.min(F.struct("node", "samples")).alias("low"),
                                                F.count(F.lit(1)).alias("n")).filter("n > 1")
    star = (banded.join(buckets, ["band", "key"]).filter("node <> low.node")
            .select(F.col("low.node").alias("center"), "low.samples", "node", F.col("samples").alias("own")).distinct())
    star = staged(star.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(1 << 20))), "stars")
    parts = star.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    dealt = star.join(parts, "center").withColumn("grp", F.concat_ws(":", "center", F.expr("salt % parts")))
    plain = [F.lit(False).alias("outer"), F.lit(-1).alias("band")]
    groups = (dealt.select("grp", F.lit(0).alias("kind"), F.col("center").alias("node"), F.col("center").alias("comp"),
                           *plain, "samples").distinct()
              .unionByName(dealt.select("grp", F.lit(1).alias("kind"), "node", F.col("node").alias("comp"), *plain,
                                        F.col("own").alias("samples"))))
    links = staged(verified(groups, source, *settings, threshold, bands, rows), "links")
    component = staged(connected_components(links), "components")

    # buckets whose classes are in several components
    labelled = banded.join(component, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    shares = labelled.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (shares.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"),
                                               F.count(F.lit(1)).alias("comps")).filter("comps > 1")
             .withColumn("tiles", F.ceil((F.col("n") - F.col("main.n")) / BLOCK))
             .withColumn("parts", F.ceil(F.col("n") / MEMBERS)))
    inside = (labelled.join(mixed, ["band", "key"])
              .select("band", "key", "node", "samples", "comp", "tiles", "parts",
                      (F.col("comp") != F.col("main.comp")).alias("outer")))
    dice = lambda label, n: F.pmod(F.xxhash64("node", F.lit(label)), F.col(n))
    head = inside.filter("outer").withColumn("tile", dice("tile", "tiles")).withColumn(
        "part", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("kind", F.lit(0))
    body = inside.withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1)"))).withColumn(
        "part", dice("part", "parts")).withColumn("kind", F.lit(1))
    blocks = staged(head.unionByName(body).select(
        F.concat_ws(":", "band", "key", "tile", "part").alias("grp"), "kind", "node", "comp", "outer", "band", "samples"),
        "blocks")
    more = verified(blocks, source, *settings, threshold, bands, rows)
    final = connected_components(links.unionByName(more))
    label = (sketch.select("doc_id", "print").join(classes.select("print", "node"), "print")
             .join(final, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("c")))
    return (source.select("doc_id").join(label, "doc_id", "left")
            .select("doc_id", F.coalesce("c", "doc_id").alias("class_id"))
            .withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True))))
