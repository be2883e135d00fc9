"""Near-duplicate vectors by a PCA-ordered tiled comparison.

1. Equal vectors of a label are one class with a count of copies; its smallest id stands for it.
2. The second-moment matrix of all unit vectors is summed over the cluster; its eigenvectors give the
   order of dimensions. Rotation keeps cosines.
3. Two unit vectors with cosine >= t are at most sqrt(2 - 2t) apart, so on each leading axis they lie in
   equal or neighbouring cells of that width. A vector is sent to its own cell and, as a visitor, to one half
   of the neighbouring cells, so that each close pair of cells meets once.
4. A cell is cut into tiles of at most about ``tile`` rows; a group of rows is a pair of tiles, so no task
   holds a whole hot cell. A tile pair multiplies the leading dimensions, adds the product of the suffix
   norms, and goes on with more dimensions only for pairs whose bound still reaches the threshold.
5. A tile pair returns link counts and a spanning forest, never its pairs. Components follow from the forests.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import staged
from tallyward.llm.components import connected_components

SLACK = 1e-12


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Row lengths, and per length the unit vectors of its rows in order."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(lengths)
    out = {}
    for d in np.unique(lengths):
        starts = (ends - lengths)[lengths == d]
        rows = flat[starts[:, None] + np.arange(d)]
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)
        out[int(d)] = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return lengths, out


def second_moments(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension count D the D x D second-moment matrix of the unit vectors; D * D numbers reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in unit_rows(b.column(0))[1].items():
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_pydict({"d": np.full(d * d, d), "i": i, "j": j, "v": m.ravel()})

    sums = classes.select("vec").mapInArrow(moments, "d long, i long, j long, v double") \
        .groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in sums.groupby("d"):
        m = np.zeros((d, d))
        m[part.i, part.j] = part.v
        out[int(d)] = m
    return out


def principal_axes(moments: np.ndarray) -> np.ndarray:
    """Columns: orthonormal axes, largest second moment first."""
    _, axes = np.linalg.eigh((moments + moments.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, step: int = 16,
                part: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with dot product >= threshold, by leading dimensions first; ``same``: only i < j."""
    d = a.shape[1]
    cuts = list(range(step, d, step)) + [d]
    square = lambda x: np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    na, nb = square(a), square(b)
    tail = lambda n, k: np.sqrt(n[:, k]) if k < d else np.zeros(len(n))
    lead = a[:, :cuts[0]] @ b[:, :cuts[0]].T
    keep = lead + np.outer(tail(na, cuts[0]), tail(nb, cuts[0])) >= threshold - SLACK
    if same:
        keep = np.triu(keep, 1)
    rows, cols = np.nonzero(keep)
    for at in range(0, len(rows), part):
        i, j = rows[at:at + part], cols[at:at + part]
        s = lead[i, j]
        for low, high in itertools.pairwise(cuts):
            s = s + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
            ok = s + tail(na, high)[i] * tail(nb, high)[j] >= threshold - (SLACK if high < d else 0)
            i, j, s = i[ok], j[ok], s[ok]
        if len(cuts) == 1:
            ok = s >= threshold
            i, j = i[ok], j[ok]
        yield i, j


def tile_links(vectors: list[np.ndarray], copies: list[np.ndarray], ids: list[np.ndarray], threshold: float):
    """Links of one tile (one array each) or between two: ids, weighted link counts, forest roots."""
    same = len(vectors) == 1
    a, b = vectors[0], vectors[-1]
    shift = 0 if same else len(a)
    node, weight = np.concatenate(ids), np.concatenate(copies)
    links, root = np.zeros(len(node), np.int64), node.copy()
    pairs = []
    for i, j in close_pairs(a, b, threshold, same):
        j = j + shift
        links += np.bincount(i, weight[j], len(node)).astype(np.int64)
        links += np.bincount(j, weight[i], len(node)).astype(np.int64)
        pairs.append((i, j))
    changed = bool(pairs)
    while changed:
        before = root.copy()
        for i, j in pairs:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        changed = not np.array_equal(before, root)
    return node, links, root


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                           vector_col: str = "embedding", label_col: str = "label", grid_dims: int = 2,
                           tile: int = 1024) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable),
    kept (the id is its component's).

    Vectors are compared when their labels are equal and not null and they have the same length; a link is
    a cosine >= threshold in double precision. Null, empty and zero vectors, those with null or non-finite
    components, and rows with a null label link with nothing and keep themselves. A row with a null id links
    with nothing and has a null component. Equal rows (id, label and vector) count as one vector and are
    returned each; rows that share only the id are separate vectors of one node. Other columns are
    ignored; an empty table gives an empty result.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    source = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                            F.col(f"`{vector_col}`").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("vec", lambda x: x != 0)
    usable = source.filter("vec_id is not null and label is not null and vec is not null").filter(fine)
    classes = staged(
        usable.groupBy("label", "vec", "vec_id").agg(F.lit(1).alias("one"))
        .groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    axes = {d: principal_axes(m) for d, m in second_moments(classes).items()}
    width = math.sqrt(2 - 2 * threshold) * (1 + 1e-9)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, copies = (b.column(k).to_numpy() for k in (2, 3))
            lengths, unit = unit_rows(b.column(1))
            for d, x in unit.items():
                at = np.nonzero(lengths == d)[0]
                y = x @ axes[d]
                k = min(grid_dims, d)
                home = np.floor(y[:, :k] / width).astype(np.int64)
                blobs = [row.tobytes() for row in y]
                half = [s for s in itertools.product((-1, 0, 1), repeat=k) if s >= (0,) * k]
                for s in half:
                    cells = [f"{d}:" + ",".join(map(str, c)) for c in (home + np.array(s)).tolist()]
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(at)), pa.array(cells),
                        pa.array(np.full(len(at), any(s)), pa.bool_()), pa.array(rep[at]), pa.array(copies[at]),
                        pa.array(blobs, pa.binary())], names=["label", "cell", "visitor", "rep", "copies", "y"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    placed = staged(classes.select("label", "vec", "rep", "copies").mapInArrow(
        to_cells, f"label {kinds['label']}, cell string, visitor boolean, rep {kinds['rep']}, copies long, y binary"),
        "cells")
    sizes = placed.groupBy("label", "cell").agg(
        F.ceil(F.sum(F.when(F.col("visitor"), 0).otherwise(1)) / tile).alias("homes"),
        F.ceil(F.sum(F.when(F.col("visitor"), 1).otherwise(0)) / tile).alias("visits")).filter("homes > 0")
    dealt = placed.join(sizes, ["label", "cell"]).withColumn(
        "t", F.pmod(F.xxhash64("rep", "y"), F.when(F.col("visitor"), F.col("visits")).otherwise(F.col("homes"))))
    # (first, second): tiles 0 .. homes-1 are homes, from homes on visitors
    others = F.expr("""case when visitor then transform(sequence(0, homes - 1), i -> struct(i as p, homes + t as q, true as second))
        else transform(sequence(0, homes + visits - 1),
                       i -> struct(least(i, t) as p, greatest(i, t) as q, i < t as second)) end""")
    grouped = dealt.withColumn("o", F.explode(others)).select("label", "cell", "o.*", "rep", "copies", "y")

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy(zero_copy_only=False)
        sides = [~second] + ([second] if key[2].as_py() != key[3].as_py() else [])
        blob = table.column("y").to_pylist()
        y = np.frombuffer(b"".join(blob)).reshape(len(blob), -1)
        rep, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
        if any(not s.any() for s in sides):
            node = n = root = rep[:0]
        else:
            node, n, root = tile_links([y[s] for s in sides], [copies[s] for s in sides], [rep[s] for s in sides],
                                       threshold)
        some = n > 0
        return pa.table({"rep": node[some], "links": n[some].astype(np.int64), "root": root[some]})

    found = staged(grouped.groupBy("label", "cell", "p", "q").applyInArrow(
        links, f"rep {kinds['rep']}, links long, root {kinds['rep']}"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    member = (classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
              .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                      F.coalesce("component", "rep").alias("c")))
    linked = F.col("n").isNotNull() & F.col("vec_id").isNotNull()
    return source.join(member, ["label", "vec"], "left").select(
        "vec_id", F.when(linked, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("c")).otherwise(F.col("vec_id")).alias("component_id"),
        F.coalesce(F.when(linked, F.col("c")).otherwise(F.col("vec_id")) == F.col("vec_id"), F.lit(False)).alias("kept"))
