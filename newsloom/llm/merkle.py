"""Merkle manifest of a dataset: one tree a source, the sources' roots in a tree of their own (operator 13).

No global sort: the rank of a document within its source comes from a trie of histograms. A row's key is a fixed-length
string whose order is that of the ids (hex digits of the id, then of the leaf, which parts repeated ids). A histogram of
key prefixes is rolled up three digits at a time; sums over siblings, at most 4096 of them, going down, give each prefix
its first rank. Only the last bucket, a bounded number of keys, is numbered by a window. Buckets that hold more keys
(repeated ids) are divided again by further digits.

The digits of the rank in the base of the fan-out are the node's name in the tree, and its parent's name is the name
without the last digit. The longest names are reduced first: a round cuts the last ``LEVELS`` digits off, so the nodes that
share what is left are one block of at most fanout ** LEVELS, hashed level by level in one step. Going down again, each
block tells its members the siblings on their way to the root. Every round is a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from newsloom.llm.common import Scratch

FANOUT = 3
#: Levels of a tree in one block: 3 ** 5 = 243 nodes.
LEVELS = 5
#: Digits of a step of the histograms, and how many keys a bucket may have to be numbered at once.
STEP, BUCKET = 3, 4096
#: Copies of one row that are numbered in one go.
COPIES = 1024
BLOCK = pa.schema([("by", pa.string()), ("name", pa.string()), ("digest", pa.string())])
PATH = pa.schema([("by", pa.string()), ("name", pa.string()), ("up_left", pa.list_(pa.string())), ("up_right", pa.list_(pa.string())), ("subroot", pa.string())])
PROOF = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def digest(*fields: Column) -> Column:
    """sha256 over the fields: ``-`` for null, else the UTF-8 length, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def id_key(doc_id: Column) -> Column:
    """17 digits in the order of the ids, null first: a digit for null, then 16 of the id with its sign turned."""
    turned = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.when(doc_id.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), turned))


def ranked(rows: DataFrame, lengths: list[int], scratch: Scratch) -> DataFrame:
    """``rows`` (by, key, n, ...) with ``rank``, the sum of n over the rows of the same ``by`` with a smaller key, and ``total``, the
    sum over all of them; keys are unique within ``by``."""
    def first(part: DataFrame, size: int, parent: DataFrame | None) -> DataFrame:
        """First ranks of prefixes (by, p, n, k): their parent's, and what their smaller siblings hold."""
        part = part.withColumn("up", F.substring("p", 1, size) if size else F.lit(""))
        part = part.withColumn("base", F.sum("n").over(W.partitionBy("by", "up").orderBy("p")) - F.col("n"))
        if parent is None:
            part = part.withColumn("total", F.sum("n").over(W.partitionBy("by", "up")))
        else:
            above = parent.select("by", F.col("p").alias("up"), F.col("base").alias("before"), "total")
            part = part.join(above, ["by", "up"]).withColumn("base", F.col("base") + F.col("before"))
        return part.select("by", "p", "n", "k", "base", "total")

    def counted(some: DataFrame, length: int, key: str = "key", k=None) -> DataFrame:
        return some.groupBy("by", F.substring(key, 1, length).alias("p")).agg(F.sum("n").alias("n"), (F.count("*") if k is None else F.sum(k)).alias("k"))

    steps = [scratch.cut(counted(rows, lengths[-1]))]
    for length in reversed(lengths[:-1]):
        steps.insert(0, counted(steps[0], length, "p", "k"))
    known, size = None, 0
    for part, length in zip(steps, lengths):
        known, size = first(part, size, known), length
    known, rest, out = scratch.cut(known), rows, None
    while True:
        inside = W.partitionBy("by", "p").orderBy("key")
        some = rest.withColumn("p", F.substring("key", 1, size)).join(known.where(F.col("k") <= BUCKET).select("by", "p", "base", "total"), ["by", "p"])
        some = some.withColumn("rank", F.col("base") + F.sum("n").over(inside) - F.col("n")).drop("p", "base")
        out = some if out is None else out.unionByName(some)
        large = known.where(F.col("k") > BUCKET)
        if large.isEmpty():
            return out
        # many different rows share such a prefix, as when they share an id
        rest = scratch.cut(rest.withColumn("p", F.substring("key", 1, size)).join(large.select("by", "p"), ["by", "p"], "left_semi").drop("p"))
        known, size = scratch.cut(first(counted(rest, size + STEP), size, large)), size + STEP


def each_copy(rows: DataFrame) -> DataFrame:
    """One row for each of the n equal rows that a row stands for, with ranks of their own."""
    def one_by_one(some: DataFrame, n: Column) -> DataFrame:
        return some.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("rank", F.col("rank") + F.col("copy")).drop("copy")

    few, many = rows.where(F.col("n") <= COPIES), rows.where(F.col("n") > COPIES)
    many = many.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("by", "key", "lot")
    many = many.withColumn("rank", F.col("rank") + F.col("lot") * COPIES).withColumn("n", F.least(F.col("n") - F.col("lot") * COPIES, F.lit(COPIES))).drop("lot")
    return one_by_one(few, F.col("n")).unionByName(one_by_one(many, F.col("n")))


def depth(total: Column) -> Column:
    """Levels above the leaves of a tree with so many: the least d with FANOUT ** d >= total."""
    out, level = F.lit(0), 1
    while FANOUT ** (level - 1) < 1 << 62:
        out, level = F.when(total > FANOUT ** (level - 1), level).otherwise(out), level + 1
    return out


def named(nodes: DataFrame) -> DataFrame:
    """Nodes with their rank's digits as ``name``, as many digits for all nodes of a tree."""
    digits = F.lpad(F.conv(F.col("rank").cast("string"), 10, FANOUT), depth(F.col("total")), "0")
    return nodes.withColumn("name", F.when(F.col("total") <= 1, "").otherwise(digits)).drop("rank", "total")


def blocks(nodes: DataFrame, members: list[str]) -> DataFrame:
    """Nodes (by, name, digest, members) gathered by their names without the last digits, in order."""
    fields = F.struct("name", "digest", *members)
    block, levels = F.expr(f"substring(name, 1, greatest(char_length(name) - {LEVELS}, 0))"), F.least(F.char_length("name"), F.lit(LEVELS))
    return nodes.groupBy("by", block.alias("block"), levels.alias("levels")).agg(F.sort_array(F.collect_list(fields)).alias("nodes"))


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tower(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of a block, level by level up to its top."""
    out = [digests]
    for _ in range(levels):
        out.append([_h(*out[-1][k:k + FANOUT]) for k in range(0, len(out[-1]), FANOUT)])
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands to the left and to the right of member ``at`` in its run, on each level."""
    left, right = [], []
    for level in levels[:-1]:
        run = at // FANOUT * FANOUT
        left.append("".join(level[run:at]))
        right.append("".join(level[at + 1:run + FANOUT]))
        at //= FANOUT
    return left, right


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(b["by"], b["block"], tower([x["digest"] for x in b["nodes"]], b["levels"])[-1][0]) for b in batch.to_pylist()], BLOCK)


def reduced(nodes: DataFrame, members: list[str], most: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, longest names first, and the top (by, digest) of each tree; names have ``most`` digits at most."""
    rounds = []
    for k in range(max(1, -(-most // LEVELS))):
        rounds.append(scratch.cut(blocks(nodes, [] if k else members)))
        nodes = scratch.cut(rounds[-1].mapInArrow(_tops, from_arrow_schema(BLOCK)))
    return rounds, nodes.select("by", "digest")


def _members(batch: pa.RecordBatch):
    """Every member of the blocks with its block and the siblings on its way to the root."""
    for block in batch.to_pylist():
        levels = tower([x["digest"] for x in block["nodes"]], block["levels"])
        for at, x in enumerate(block["nodes"]):
            left, right = siblings(levels, at)
            yield block, x, [*left, *block["up_left"]], [*right, *block["up_right"]]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(b["by"], x["name"], left, right, b["subroot"]) for b, x, left, right in _members(batch)], PATH)


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(x["of"], "", left, right, x["digest"]) for _, x, left, right in _members(batch)], PATH)


def _proofs(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, x, left, right in _members(batch):
                folded = x["found"] or x["digest"]
                for a, c in zip(left, right):
                    folded = _h(a, folded, c)
                out.append((x["doc_id"], x["digest"], b["subroot"], root, _h(*[y for pair in zip(left, right) for y in pair]), folded, folded == root))
            yield _batch(out, PROOF)

    return run


def _down(rounds: list[DataFrame], top: DataFrame, last, kind: pa.Schema, scratch: Scratch) -> DataFrame:
    """Carries paths from the tops of trees down to the members of the first round, to which ``last`` is applied."""
    for k, block in reversed(list(enumerate(rounds))):
        known = block.join(top.withColumnRenamed("name", "block"), ["by", "block"])
        if not k:
            return known.mapInArrow(last, from_arrow_schema(kind))
        top = scratch.cut(known.mapInArrow(_nodes, from_arrow_schema(PATH)))


def manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and whether that equals the root.

    ``found_text``, a Column over ``docs``, is the text as it is found at verification (the text itself if not given): the leaf made of it
    is folded with the original siblings. Null fields count as ``-``, empty ones as ``0:``; null sources form a tree of their own, the
    first. Null ids come first; rows of one id are ordered by their leaves, and equal rows are leaves side by side. An empty table
    has no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    x = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in fields], (F.col("text") if found_text is None else found_text).cast("string").alias("found"))
    by = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("1"), F.hex(F.encode("source", "UTF-8"))))
    leaves = x.select(by.alias("by"), "doc_id", digest(*map(F.col, fields)).alias("digest"), digest(*map(F.col, fields[:-1]), F.col("found")).alias("found"))
    leaves = leaves.groupBy("by", F.concat(id_key(F.col("doc_id")), "digest").alias("key")).agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("digest").alias("digest"), F.any_value(F.when(F.col("found") != F.col("digest"), F.col("found"))).alias("found"), F.count("*").alias("n"))
    leaves = scratch.cut(leaves)
    nodes = scratch.cut(named(each_copy(ranked(leaves, [3, 6, 9, 12, 15], scratch))).select("by", "name", "digest", "doc_id", "found"))
    most = nodes.agg(F.max(F.char_length("name")).alias("n")).head()["n"] or 0
    rounds, subroots = reduced(nodes, ["doc_id", "found"], most, scratch)

    sources = subroots.select(F.lit("").alias("by"), F.col("by").alias("key"), F.col("by").alias("of"), "digest", F.lit(1).cast("long").alias("n"))
    sources = scratch.cut(named(ranked(sources, [STEP], scratch)).select("by", "name", "digest", "of"))
    most = sources.agg(F.max(F.char_length("name")).alias("n")).head()["n"] or 0
    upper, top = reduced(sources, ["of"], most, scratch)
    root = top.head()
    start = docs.sparkSession.createDataFrame([("", "", [], [], "")], from_arrow_schema(PATH))
    tops = scratch.cut(_down(upper, start, _sources, PATH, scratch))
    return _down(rounds, tops, _proofs(root["digest"] if root else ""), PROOF, scratch)
