"""Hard negatives by products in an orthogonal PCA basis (operator 11).

Scores are integer inner products. All vectors are turned into the basis of the eigenvectors of their second moments, which
leaves inner products as they are and moves most of their length into the leading components. A pair's product is
summed over a few leading components first; what is missing is at most the product of the norms of the two remainders
(Cauchy-Schwarz) plus a slack for the rounding of the rotation and of the sums. A pair goes on to the next components only while
that interval reaches a score that is still wanted; the survivors are scored by integer products, which alone decide.

Two passes over a grid of tiles, anchors against vectors, each cell a task with bounded memory: the first finds an
anchor's best rows of its own label, the second the best rows of other labels in the interval each positive allows. A cell
keeps the best found so far as its bar and returns a few rows an anchor; Spark merges those of all cells. The number of cells is
quadratic by nature of an exact search; what the bounds save is the work in a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch

TILE, ANCHOR_TILE, STRIP = 8192, 1024, 512
#: Share of the components after which a pair is looked at again, and of pairs up to which only those that are left are summed.
STAGES, SPARSE = (0.125, 0.25, 0.5, 1.0), 0.1
#: Pairs that are summed at once.
CHUNK = 1 << 16
SCALE = 256
LOW, HIGH = -(1 << 62), 1 << 62
FOUND = "rid long, slot int, other long, place long, score long"


def integers(vector: Column) -> Column:
    """floor(256 * x) of the components."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor with a null, NaN or infinite component, and short enough for scores of 64 bits."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    length = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(F.lit(float(SCALE)) * F.abs(x.cast("double")) + 1, F.lit(2.0)))
    return F.coalesce(good & (length < float(1 << 61)), F.lit(False))


def bases(rows: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal basis for each number of dimensions: eigenvectors of the summed second moments, the largest first."""
    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for q in _by_size(batch.column(0)):
                q = q.astype(np.float64)
                sums[q.shape[1]] = sums.get(q.shape[1], 0.0) + q.T @ q
        for dims, m in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(dims * dims, dims, np.int32)), pa.array(np.arange(dims * dims, dtype=np.int64)), pa.array(m.ravel())], names=["dims", "at", "m"])

    found: dict[int, np.ndarray] = {}
    parts = rows.where(F.size("q") > 0).select("q").mapInArrow(moments, "dims int, at long, m double")
    # dims * dims sums for each number of dimensions, whatever the number of rows
    for r in parts.groupBy("dims", "at").agg(F.sum("m").alias("m")).collect():
        found.setdefault(r["dims"], np.zeros((r["dims"], r["dims"]))).ravel()[r["at"]] = r["m"]
    return {dims: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for dims, m in found.items()}


def _by_size(lists: pa.Array):
    """The rows of a list column as matrices, one for each length of list."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        own = lists.filter(pa.array(sizes == n))
        yield own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), n)


class Turned:
    """Integer vectors with their form in a basis and the norms of what remains after each stage."""

    def __init__(self, q: np.ndarray, basis: np.ndarray):
        self.q, self.z = q, q.astype(np.float64) @ basis
        dims = q.shape[1]
        self.cuts = sorted({max(1, round(dims * s)) for s in STAGES}) if dims else [0]
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        # up to the relative rounding of a sum of squares
        self.rest = [np.sqrt((self.z[:, k:] ** 2).sum(1)) * (1 + 1e-12 * (dims + 1)) for k in self.cuts]
        # how far products in the basis may be from the true ones, by the product of the norms: departure of the basis
        # from orthogonality, and rounding of the rotation and of the sums, each at most dims + 2 units a term
        unit = np.finfo(np.float64).eps
        self.slack = np.linalg.norm(basis.T @ basis - np.eye(dims)) + np.linalg.norm(basis @ basis.T - np.eye(dims)) + 16 * unit * (dims + 2) ** 1.5


def survivors(x: Turned, y: Turned, at: slice, want) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x in the strip, row of y) whose interval ``want(i, j, low, high)`` accepts after every stage.

    ``want`` gets index arrays that broadcast against the bounds.
    """
    z, norm = x.z[at], x.norm[at]
    i = j = part = None
    done = 0
    for k, cut in enumerate(x.cuts):
        if i is None:
            more = z[:, done:cut] @ y.z[:, done:cut].T
            part = more if part is None else part + more
            off = np.outer(x.rest[k][at], y.rest[k]) + x.slack * np.outer(norm, y.norm) + 1e-6
            keep = want(np.arange(len(z))[:, None], np.arange(len(y.z))[None, :], part - off, part + off)
            if keep.mean() <= SPARSE or k == len(x.cuts) - 1:
                i, j = np.nonzero(keep)
                part = part[i, j]
        else:
            kept = []
            for lo in range(0, len(i), CHUNK):
                a, b = i[lo:lo + CHUNK], j[lo:lo + CHUNK]
                p = part[lo:lo + CHUNK] + np.einsum("ij,ij->i", z[a, done:cut], y.z[b, done:cut])
                off = x.rest[k][at][a] * y.rest[k][b] + x.slack * norm[a] * y.norm[b] + 1e-6
                kept.append((p, want(a, b, p - off, p + off)))
            if kept:
                keep = np.concatenate([w for _, w in kept])
                i, j, part = i[keep], j[keep], np.concatenate([p for p, _ in kept])[keep]
        done = cut
    return i, j


class Best:
    """The ``k`` best (score, then id) of each slot so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.order, self.other = k, *(np.empty(0, np.int64) for _ in range(4))
        self.bar = np.full(slots, LOW)

    def add(self, slot, score, order, other) -> None:
        slot, score, order, other = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.order, order), (self.other, other)))
        by = np.lexsort((other, order, -score, slot))
        slot = slot[by]
        start = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, bool)
        place = np.arange(len(slot)) - np.maximum.accumulate(np.where(start, np.arange(len(slot)), 0)) if len(slot) else np.empty(0, np.int64)
        keep = place < self.k
        by, slot = by[keep], slot[keep]
        self.slot, self.score, self.order, self.other = slot, score[by], order[by], other[by]
        full = place[keep] == self.k - 1
        self.bar[slot[full]] = self.score[full]


def _exact(x: Turned, y: Turned, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), CHUNK):
        out[lo:lo + CHUNK] = np.einsum("ij,ij->i", x.q[i[lo:lo + CHUNK]], y.q[j[lo:lo + CHUNK]])
    return out


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, t.column("dims")[0].as_py())


def _cell(turn: dict[int, np.ndarray], k: int, least: int, most: int, positives: bool):
    """A cell of the grid: for each anchor (and positive) the k best rows of the tile."""
    def run(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        if not vectors.num_rows or not anchors.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.int32() if c.endswith("int") else pa.int64()) for c in FOUND.split(", ")})
        q, a = _matrix(vectors), _matrix(anchors)
        basis = turn.get(q.shape[1], np.zeros((0, 0)))
        x, y = Turned(q, basis), Turned(a, basis)
        get = lambda t, c: t.column(c).to_numpy()
        rid, order, label = get(vectors, "rid"), get(vectors, "place"), get(vectors, "label")
        own, own_label = get(anchors, "rid"), get(anchors, "label")
        if positives:
            low, high = np.full((len(own), 1), LOW), np.full((len(own), 1), HIGH)
        else:  # as many slots as an anchor has positives; those that it lacks want nothing
            low, high = np.full((len(own), k), HIGH), np.full((len(own), k), LOW)
            for n, scores in enumerate(anchors.column("scores").to_pylist()):
                low[n, :len(scores)], high[n, :len(scores)] = [-(-least * z // 100) for z in scores], [most * z // 100 for z in scores]
        slots = low.shape[1]
        best = Best(low.size, k)
        for lo in range(0, len(q), STRIP):
            at = slice(lo, min(lo + STRIP, len(q)))
            bar = np.maximum(best.bar.reshape(low.shape), low)

            def want(i, j, least, most):
                ok = (label[at][i] == own_label[j]) == positives
                if positives:
                    ok &= rid[at][i] != own[j]
                some = np.zeros(ok.shape, bool)
                for s in range(slots):
                    some |= (most >= bar[j, s]) & (least <= high[j, s])
                return ok & some

            i, j = survivors(x, y, at, want)
            score = _exact(x, y, i + lo, j)
            for s in range(slots):
                hit = (score >= low[j, s]) & (score <= high[j, s])
                best.add(j[hit] * slots + s, score[hit], order[i[hit] + lo], rid[i[hit] + lo])
        return pa.table({"rid": pa.array(own[best.slot // slots]), "slot": pa.array((best.slot % slots).astype(np.int32)), "other": pa.array(best.other), "place": pa.array(best.order), "score": pa.array(best.score)})

    return run


def _grid(rows: DataFrame, column: str, size: int, other: str, cells: int) -> DataFrame:
    """Rows dealt over tiles by ``rid`` and copied to every tile of the other side."""
    return rows.withColumn(column, F.pmod(F.xxhash64("rid"), F.lit(size)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
    least: int = 80, most: int = 100, tile: int = TILE, anchor_tile: int = ANCHOR_TILE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``k`` best rows of the same
    label the ``k`` best rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score.

    ``anchors`` says which rows are anchors, ``label`` replaces the column of that name; both are Columns over ``vectors``. Vectors
    that are null or have null or non-finite components take no part, nor do null labels or vectors whose scores could pass 64 bits (a norm over
    about 6e6); vectors of different dimensions have no score. Ties go to the smaller id, null ids last. Rows that repeat an id are rows of their
    own, anchors too; an empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.when(usable(v), integers(v)).alias("q"))
    rows = rows.where("q is not null and label is not null").withColumn("rid", F.monotonically_increasing_id())
    # rows of one id and score may stand in any order: what is returned of them is the same
    rows = scratch.cut(rows.withColumn("place", F.coalesce("id", F.lit((1 << 63) - 1))).withColumn("dims", F.size("q")))
    turn = bases(rows)
    some = rows.where("anchor").select("rid", "label", "dims", "q")
    n, m = rows.agg(F.count("*"), F.count_if("anchor")).head()
    across, down = max(1, -(-n // tile)), max(1, -(-m // anchor_tile))
    tiles = _grid(rows.select("rid", "label", "dims", "q", "place"), "t", across, "a", down).groupBy("dims", "t", "a")

    def searched(anchors: DataFrame, positives: bool) -> DataFrame:
        cells = tiles.cogroup(_grid(anchors, "a", down, "t", across).groupBy("dims", "t", "a"))
        found = cells.applyInArrow(_cell(turn, k, least, most, positives), FOUND)
        first = W.partitionBy("rid", "slot").orderBy(F.col("score").desc(), "place", "other")
        return scratch.cut(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k))

    ids = rows.select(F.col("rid").alias("other"), "id")
    positive = searched(some, True).join(ids, "other").select("rid", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    positive = scratch.cut(positive)
    wanted = positive.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x.positive_score).alias("scores"))
    negative = searched(scratch.cut(some.join(wanted, "rid")), False).join(ids, "other").select("rid", "slot", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = rows.where("anchor").select("rid", F.col("id").alias("anchor_id"))
    return negative.join(positive, ["rid", "slot"]).join(named, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
