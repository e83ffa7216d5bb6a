"""Embedding near-duplicates by int8 tile products with error bounds (operator 9).

Every vector is scaled to length one and stored as int8 codes with its own step. Vectors are dealt over tiles by a
hash, and each pair of tiles is one task: the product of the two code matrices (whole numbers, exact in single
precision up to 1040 dimensions and split beyond) approximates all cosines between them.

The bound is rigorous: with u = s·c + e, where |e| is the vector's measured quantisation error, the cosine differs
from the product of the scaled codes by at most |e_u| (|v| + |e_v|) + |e_v| |u|, here |e_u| + |e_v| + |e_u||e_v|, plus
a margin for rounding. Only pairs whose upper bound reaches the threshold are computed again, in double precision.

Equal vectors are one class with a count. A tile pair returns, per class, the number of vectors it links there and
a spanning star of the links, so the output is linear whatever the density. The work is quadratic in the
number of distinct vectors by nature of the exhaustive method; the memory of a task is bounded by the tile size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, components
from newsloom.llm.simhash import spanning

THRESHOLD = 0.9
TILE = 8192
STRIP = 512
EXACT_DIMS = 1040  # 127 * 127 * 1040 < 2^24


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, steps and error norms of the rows of a matrix of unit vectors."""
    step = np.abs(unit).max(1) / 127.0
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * step[:, None]) ** 2).sum(1))
    return codes, step, error * (1 + 1e-9) + 1e-12


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of code matrices."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((_product(a[:, k:k + EXACT_DIMS], b[:, k:k + EXACT_DIMS]).astype(np.float64) for k in range(0, a.shape[1], EXACT_DIMS)), 0.0)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of x and y (of x and itself, i < j, when y is None)."""
    def unit(m):
        m = m.astype(np.float64)
        m = m / np.abs(m).max(1, keepdims=True)  # neither overflow nor underflow in the norm
        return m / np.sqrt((m * m).sum(1, keepdims=True))

    ux = unit(x)
    uy = ux if y is None else unit(y)
    (cx, sx, ex), (cy, sy, ey) = quantise(ux), quantise(uy)
    far = threshold - (ex.max() + ey.max() + ex.max() * ey.max() + 1e-9)
    out_i, out_j = [], []
    for at in range(0, len(cx), STRIP):
        first = at if y is None else 0
        p = _product(cx[at:at + STRIP], cy[first:])
        # a cheap test by the largest bound, then each pair's own
        i, j = np.nonzero(p * sx[at:at + STRIP, None].astype(np.float32) >= (far / sy[first:] * (1 - 1e-5)).astype(np.float32))
        v, i, j = p[i, j].astype(np.float64), i + at, j + first
        keep = v * sx[i] * sy[j] + ex[i] + ey[j] + ex[i] * ey[j] + 1e-9 >= threshold
        if y is None:
            keep &= i < j
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 65536):
            a, b = i[k:k + 65536], j[k:k + 65536]
            hit = (ux[a] * uy[b]).sum(1) >= threshold
            out_i.append(a[hit])
            out_j.append(b[hit])
    cat = lambda z: np.concatenate(z) if z else np.empty(0, np.int64)
    return cat(out_i), cat(out_j)


def _task(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf.left].reset_index(drop=True)
        right = pdf[~pdf.left].reset_index(drop=True)
        if not len(left) or not pdf.both.iloc[0] and not len(right):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        both = bool(pdf.both.iloc[0])
        x = np.stack(left.v.to_numpy())
        y = None if both else np.stack(right.v.to_numpy())
        i, j = tile_links(x, y, threshold)
        rows = left if both else pd.concat([left, right], ignore_index=True)
        if not both:
            j = j + len(left)
        n = rows.n.to_numpy()
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        rep = rows.rep.to_numpy()
        root = rep[spanning(len(rows), i, j)]
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Null, empty and zero vectors, and those with null, NaN or infinite components, link with nothing; so do vectors of
    different dimensions. Repeated rows count as separate vectors, and rows that share an id are different vectors too:
    what links is the vector. A null id never names a component that has another id, and is kept only where none has;
    an empty table gives an empty result. Other columns are neither read nor returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.col(vec_col)
    # NaN compares greater than infinity in Spark
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # a class is known by a number of its own, as ids may be null or repeated
    classes = scratch.cut(classes.withColumn("dims", F.size("v")).withColumn("rep", F.monotonically_increasing_id()))
    tiles = max(1, -(-classes.count() // tile))
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    dealt = (
        classes.withColumn("t", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int")).withColumn("o", F.explode(every))
        .select("dims", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), (F.col("t") <= F.col("o")).alias("left"), (F.col("p") == F.col("q")).alias("both"), "rep", "n", "v")
    )
    found = scratch.cut(dealt.groupBy("dims", "p", "q").applyInPandas(_task(threshold), "rep long, links long, root long"))
    member = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(member, classes.rep == member.node, "left").select(
        "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    named = scratch.cut(named)
    name = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(name, "root").select("v", "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.join(named, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
