"""Token-ID files compressed by a Re-Pair grammar (operator 2).

A file is a Parquet table of shards; a shard holds the ids of consecutive documents, about ``SHARD_TOKENS`` of them:

* ``doc_ids`` (int64) and ``doc_ends`` (int64, token offsets in the shard), little-endian like all that follows;
* ``rules`` (uint32 pairs): rule k replaces its pair by the symbol ``base`` + k;
* ``spans`` (uint32): how many ids each rule expands to, which lets a reader seek without expanding;
* ``levels`` (uint32): the number of rules after each round; ``symbols`` (uint32): what is left of the ids.

Each round counts all adjacent pairs of a shard and replaces the most frequent ones at once, left to right, by
nonterminals. Shards are independent and bounded, so memory is too, and a lost task repeats its own shards only.
Spark's committed writer makes the files: a reader never sees a part of a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_batches
from newsloom.llm.encoding import by_size, forget, public_path, shared, trim

END_ID = 1
SHARD_TOKENS = 1 << 20
ROUNDS, PAIRS, LEAST = 8, 4096, 8
SHARDS = "part int, shard int, n_tokens long, base long, doc_ids binary, null_ids binary, doc_ends binary, rules binary, spans binary, levels binary, symbols binary"


def compress(ids: np.ndarray, base: int, rounds: int = ROUNDS, pairs: int = PAIRS, least: int = LEAST):
    """(rules, spans, levels, symbols) of a sequence of ids below ``base``."""
    seq = ids.astype(np.uint32)
    rules, levels, total = [], [], 0
    for _ in range(rounds):
        if len(seq) < 2:
            break
        key = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        order = np.sort(key)
        edge = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
        count = np.diff(np.r_[edge, len(order)])
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        if len(often) > pairs:
            often = often[np.argpartition(count[often], len(often) - pairs)[-pairs:]]
        often = often[np.lexsort((order[edge[often]], -count[often]))]
        chosen = order[edge[often]]
        # a small table finds the chosen pairs; of pairs that share a slot the most frequent one is replaced this round
        def slot(k):
            return (k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
        slots = slot(chosen)
        _, first = np.unique(slots, return_index=True)
        chosen = chosen[np.sort(first)]
        find = np.zeros(1 << 18, np.int32)
        find[slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        which = find[slot(key)]
        at = np.flatnonzero(chosen[which] == key)
        # in a run of overlapping matches every other one is replaced
        start = np.r_[True, np.diff(at) != 1]
        head = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        used = np.unique(which[at])
        number = np.zeros(len(chosen), np.uint32)
        number[used] = np.arange(len(used), dtype=np.uint32)
        rules.append(np.stack([chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq[at] = base + total + number[which[at]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        total += len(used)
        levels.append(total)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    spans, at = np.ones(base + total, np.uint32), 0
    for top in levels:  # a round's rules use symbols of earlier rounds only
        spans[base + at:base + top] = spans[table[at:top]].sum(1)
        at = top
    return table, spans[base:], np.array(levels, np.uint32), seq


def expand(symbols: np.ndarray, rules: np.ndarray, levels: np.ndarray, base: int) -> np.ndarray:
    """The ids of a sequence of symbols: each rule is expanded once, by those of earlier rounds, and then gathered."""
    sizes, starts, flat = np.zeros(len(rules), np.int64), np.zeros(len(rules), np.int64), np.empty(0, np.uint32)

    def gathered(seq: np.ndarray) -> np.ndarray:
        which = np.flatnonzero(seq >= base)
        rule = seq[which].astype(np.int64) - base
        size, start = np.ones(len(seq), np.int64), np.arange(len(flat), len(flat) + len(seq))
        size[which], start[which] = sizes[rule], starts[rule]
        end = np.cumsum(size)
        at = np.repeat(start - end + size, size)
        at += np.arange(len(at))
        return np.concatenate([flat, seq])[at]

    low = 0
    for top in levels.tolist():
        pairs = rules[low:top].ravel()
        sizes[low:top] = np.where(pairs >= base, sizes[np.maximum(pairs.astype(np.int64) - base, 0)], 1).reshape(-1, 2).sum(1)
        starts[low:top] = len(flat) + np.cumsum(sizes[low:top]) - sizes[low:top]
        flat = np.concatenate([flat, gathered(pairs)])
        low = top
    return gathered(symbols)


def decode_range(symbols, rules, spans, levels, base: int, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi of a shard; only the symbols that cover them are expanded."""
    length = np.ones(len(symbols), np.int64)
    nt = symbols >= base
    length[nt] = spans[symbols[nt] - base]
    end = np.cumsum(length)
    a, b = np.searchsorted(end, lo, side="right"), np.searchsorted(end, hi, side="left") + 1
    skipped = int(end[a - 1]) if a else 0
    return expand(symbols[a:b], rules, levels, base)[lo - skipped:hi - skipped]


def write(docs: DataFrame, target: str, path: str | None = None, mode: str = "dropped", end_id: int = END_ID) -> None:
    """Encodes the texts and writes them in ascending doc_id order (null ids first) to the folder ``target``.

    A null or empty text is the end id alone; repeated ids stand side by side, ordered by a hash of the text.
    """
    path = path or public_path("word_bpe_49k.json")

    def run(batches):
        trim()
        encode = shared(path, mode)
        base, part, shard = max(encode.vocab, end_id + 1), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encode.dtype)
        ids, docs, sizes, count = [], [], [], 0

        def made():
            rules, spans, levels, symbols = compress(np.concatenate(ids), base)
            ends = np.cumsum(sizes).astype("<i8")
            num = np.array([0 if d is None else d for d in docs], "<i8")
            null = np.array([d is None for d in docs], np.uint8)
            cell = [part, shard, count, base, *(x.tobytes() for x in (num, null, ends, rules.astype("<u4"), spans.astype("<u4"), levels.astype("<u4"), symbols.astype("<u4")))]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cell, types)], names=[x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            # texts become strings a bounded number at a time
            for some in by_size(((d.as_py(), t.as_py()) for d, t in zip(*batch.columns)), lambda r: r[1]):
                flat, ends = encode.batch([t for _, t in some])
                for (d, _), a, b in zip(some, ends.tolist(), ends[1:].tolist()):
                    ids += flat[a:b], end
                    docs.append(d), sizes.append(b - a + 1)
                    count += b - a + 1
                    if count >= SHARD_TOKENS:
                        yield made()
                        shard += 1
                        ids, docs, sizes, count = [], [], [], 0
        if docs:
            yield made()
        trim()

    with arrow_batches(docs.sparkSession, 1000):
        (
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
            .mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(target)
        )


def read(spark: SparkSession, source: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files in a folder; start counts all ids before the document's."""
    shards = spark.read.schema(SHARDS).parquet(source)
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("p0"))
    inside = shards.select("part", "shard", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("s0"))
    start = inside.join(before, "part").select("part", "shard", (F.col("p0") + F.col("s0")).alias("first"))

    def run(batches):
        forget()
        for batch in batches:
            for r in batch.to_pylist():
                u4 = {k: np.frombuffer(r[k], "<u4") for k in ("rules", "levels", "symbols")}
                ids = expand(u4["symbols"], u4["rules"].reshape(-1, 2), u4["levels"], r["base"]).astype("<u4")
                ends = np.frombuffer(r["doc_ends"], "<i8")
                n = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["null_ids"], np.uint8).astype(bool)),
                    pa.array(r["first"] + ends - n), pa.array(n),
                    pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, ends * 4].astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    columns = ["first", "base", "doc_ids", "null_ids", "doc_ends", "rules", "levels", "symbols"]
    return shards.join(start, ["part", "shard"]).select(*columns).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
