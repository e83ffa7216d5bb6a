"""SimHash near-duplicates by a Gray-order hierarchical index (operator 5).

Fingerprints take three-word shingles and 64 bits; two link when they differ in at most ``radius`` = 2 bits.

The index has two parts. Its upper nodes are masked bit patterns: the 64 bits fall into four blocks of 16, and
fingerprints that differ in two bits or fewer agree on at least two whole blocks, so each fingerprint hangs under
its six patterns of two blocks. An upper node is one shuffle key, its subtree one sorted run: the rows under it are
ordered by the Gray rank of the remaining 32 bits, and nodes over sixteen neighbours keep the bits all of
them share. Self-search descends pairs of nodes and drops a pair as soon as the differences in the bits that both
share exceed what is left of the radius. A pattern with more than ``heavy`` fingerprints is split by a further
mask (two differences leave at least one of three sub-blocks whole), which bounds a run to 2^22 fingerprints.

Equal fingerprints count once, so copies never meet pairwise, and a run returns a spanning star per linked group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, components

SEED = 42
BRUTE = 256
FANOUT = 16
#: Shingles in a bucket of hashes, of four to eight on average, from which on all of them come last.
CROWDED = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash; null, empty and blank texts have fingerprint zero."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        top = min(n, at + 65536)
        h = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[at:top], ends[at + shingle - 1:top + shingle - 1])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) with fp the fingerprint as a signed long; one row per input row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def _pairs(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of uint64 values, in Gray order, that differ in at most ``radius`` bits."""
    n = len(x)
    if n <= BRUTE:
        i, j = np.triu_indices(n, 1)
        hit = np.bitwise_count(x[i] ^ x[j]) <= radius
        return i[hit], j[hit]
    levels = [(x, np.full(n, ~np.uint64(0)))]  # from the leaves up: shared value, mask of shared bits
    while len(levels[-1][0]) > FANOUT:
        value, mask = levels[-1]
        cut = np.arange(0, len(value), FANOUT)
        ones = np.bitwise_and.reduceat(value & mask, cut)
        zeros = np.bitwise_and.reduceat(~value & mask, cut)
        levels.append((ones, ones | zeros))
    m = len(levels[-1][0])
    found_i, found_j = [], []
    stack = [(len(levels) - 1, *np.triu_indices(m))]
    while stack:
        depth, i, j = stack.pop()
        value, mask = levels[depth]
        near = np.bitwise_count((value[i] ^ value[j]) & mask[i] & mask[j]) <= radius
        i, j = i[near], j[near]
        if depth == 0:
            keep = i < j
            found_i.append(i[keep])
            found_j.append(j[keep])
            continue
        below = len(levels[depth - 1][0])
        for at in range(0, len(i), 4096):
            a = (i[at:at + 4096, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            b = (j[at:at + 4096, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            a, b = (z.ravel() for z in np.broadcast_arrays(a, b))
            ok = (a <= b) & (a < below) & (b < below)
            stack.append((depth - 1, a[ok], b[ok]))
    return np.concatenate(found_i), np.concatenate(found_j)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each of n nodes' component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _search(radius: int):
    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(fp, bounds):
            out_a, out_b = [], []
            for lo, hi in bounds:
                x = fp[lo:hi]
                i, j = _pairs(x, radius)
                if len(i):
                    root = spanning(len(x), i, j)
                    child = np.flatnonzero(root != np.arange(len(x)))
                    out_a.append(x[child])
                    out_b.append(x[root[child]])
            a, b = (np.concatenate(z).view(np.int64) if z else np.empty(0, np.int64) for z in (out_a, out_b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            last = starts[-1]
            sizes = np.diff(starts)
            many = np.flatnonzero(sizes > 1)
            if len(many):
                yield links(fp, [(starts[k], starts[k] + sizes[k]) for k in many])
            key, fp = key[last:], fp[last:]
        if len(key) > 1:
            yield links(fp, [(0, len(key))])

    return run


def _gray_rank(x):
    for s in (16, 8, 4, 2, 1):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def linked(fps: DataFrame, radius: int = 2, heavy: int = 65536) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in column fp."""
    if radius > 2:
        raise ValueError("two of four blocks agree only up to two differing bits")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    under = []
    for m, (p, q) in enumerate(combinations(range(4), 2)):
        r, s = (k for k in range(4) if k not in (p, q))
        under.append(F.struct(
            (F.lit(m << 32) + F.shiftleft(block[q], 16) + block[p]).cast("long").alias("key"),
            (F.shiftleft(block[s], 16) + block[r]).cast("long").alias("rest"),
        ))
    hung = fps.select("fp", F.explode(F.array(*under)).alias("u")).select("u.key", "fp", "u.rest")
    crowded = hung.groupBy("key").count().where(F.col("count") > heavy).select("key", F.lit(True).alias("crowded"))
    sub = [F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << n) - 1)) + (k + 1) * 4096 for k, (at, n) in enumerate(((0, 11), (11, 11), (22, 10)))]
    hung = (
        hung.join(crowded, "key", "left")
        .withColumn("sub", F.explode(F.when(F.col("crowded"), F.array(*sub)).otherwise(F.array(F.lit(0).cast("long")))))
        .select((F.col("key") * 16384 + F.col("sub")).alias("key"), "fp", _gray_rank(F.col("rest")).alias("rank"))
    )
    return (
        hung.repartition("key").sortWithinPartitions("key", "rank").select("key", "fp")
        .mapInArrow(_search(radius), "a long, b long")
    )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, sh) and the kept columns: the fingerprint and the distinct hashes of the text's shingles, hashed once for both; sh is null without a word."""
    from xxhash import xxh64_intdigest

    def run(batches):
        for batch in batches:
            fps, sets = [], []
            for t in batch.column(1).to_pylist():
                words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
                if not words:
                    fps.append(0), sets.append(None)
                    continue
                h = np.array([xxh64_intdigest(b" ".join(words[k:k + shingle]), SEED) for k in range(max(1, len(words) - shingle + 1))], dtype="<u8")
                counts = np.zeros(64, dtype=np.int64)
                for at in range(0, len(h), 65536):
                    counts += np.unpackbits(h[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fps.append(int(np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]))
                sets.append(np.unique(h.view(np.int64)))
            fps = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(sets, pa.list_(pa.int64())), *batch.columns[2:]], names=["id", "fp", "sh", *kept])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *kept)
    return picked.mapInArrow(run, ", ".join(["id long, fp long, sh array<long>", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)]))


def shingle_links(docs: DataFrame, groups: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """All pairs (a, b) of ids in different groups (id, root) whose shingle sets have a Jaccard similarity of at least 0.8.

    Exact: in any one order of all shingles, sets of n shingles with that similarity share at least one of their first
    n - ceil(0.8 n) + 1. The order is by hash, and those in crowded buckets of hashes, so all frequent ones, come last.
    Shingles are shuffled as counts of buckets, and once as what comes first in each set. Ids are distinct; the members of
    one group are one row a key.
    """
    sets = scratch.cut(signatures(docs, id_col, text_col, shingle).select("id", "sh"))
    return shingle_set_links(sets, groups, scratch, sets)


def shingle_set_links(sets: DataFrame, groups: DataFrame, scratch: Scratch, spent: DataFrame) -> DataFrame:
    """``shingle_links`` of sets (id, sh) that are known; without a shingle, sh is null. ``spent``, the scratch table that has them, is dropped."""
    sets = sets.where("sh is not null").select("id", "sh", F.size("sh").alias("n"))
    buckets = 1 << max(10, ((sets.agg(F.sum("n")).head()[0] or 0) // 8).bit_length())
    bucket = F.pmod("s", F.lit(buckets)).cast("int").alias("bucket")
    each = sets.select("id", F.explode("sh").alias("s"))
    crowded = scratch.cut(each.groupBy(bucket).count().where(F.col("count") > CROWDED).select("bucket"))
    scratch.release()
    late = each.select("id", "s", bucket).join(crowded, "bucket").groupBy("id").agg(F.collect_list("s").alias("late"))
    late = scratch.cut(late)
    scratch.release()
    ordered = F.when(F.col("late").isNull(), F.sort_array("sh")).otherwise(F.concat(F.sort_array(F.array_except("sh", "late")), F.sort_array("late")))
    first = F.slice(ordered, 1, F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1)
    held = sets.join(late, "id", "left").select("id", "n", F.explode(first).alias("s"))
    # a shingle that one text, or one group, has alone links nothing; only of the others the groups are asked
    held = held.groupBy("s").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.collect_list(F.struct("id", "n")).alias("by")).where("lo <> hi")
    shared = scratch.cut(held.select("s", F.inline("by")))
    scratch.release()
    held = shared.join(groups, "id").groupBy("s", "root").agg(F.collect_list(F.struct("id", "n")).alias("of"))
    several = held.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s")
    held = scratch.cut(held.join(several, "s", "left_semi"))
    scratch.release()
    other = held.select("s", F.col("root").alias("r2"), F.col("of").alias("of2"))
    pairs = held.join(other, "s").where("root < r2").select(F.explode("of").alias("x"), "of2").select("x", F.explode("of2").alias("y"))
    pairs = pairs.where(F.least("x.n", "y.n") * 5 >= F.greatest("x.n", "y.n") * 4).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = scratch.cut(pairs)
    scratch.release()
    few = scratch.cut(sets.select("id", "sh").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))
    for done in (spent, crowded, late, shared, held):
        scratch.drop(done)
    scratch.release()
    # pairs carry a set each: about as many at once as there are sets
    passes = max(1, -(-pairs.count() // max(1, few.count())))
    common = F.size(F.array_intersect("x", "y"))
    found = []
    for k in range(passes):
        turn = [rows.where(F.pmod(F.xxhash64(F.lit(9), "a"), F.lit(passes)) == k) for rows in (pairs, few.select(F.col("id").alias("a"), F.col("sh").alias("x")))]
        both = turn[0].join(turn[1], "a").join(few.select(F.col("id").alias("b"), F.col("sh").alias("y")), "b")
        found.append(scratch.cut(both.where(common * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b")))
        del turn, both
        scratch.release()
    scratch.drop(few)
    scratch.drop(pairs)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row (id, fp, component_id) per row of ``docs``; component_id is the least id reachable over links.

    Null, empty and blank texts share fingerprint zero and so one component; repeated rows and ids are kept, null
    ids never name a component unless it has no other id; an empty table gives an empty result. Other columns are
    neither read nor returned.
    """
    scratch = Scratch(docs.sparkSession)
    return grouped(scratch.cut(fingerprints(docs, id_col, text_col, shingle)), scratch, radius)


def grouped(rows: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """``near_duplicates`` of rows (id, fp) whose fingerprints are known."""
    classes = scratch.cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    scratch.release()
    edges = linked(classes.select("fp"), radius)
    member = components(edges, scratch).withColumnRenamed("node", "fp")
    named = classes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    name = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(name, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")
