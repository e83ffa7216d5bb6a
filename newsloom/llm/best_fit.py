"""Best-fit packing planned on a histogram of lengths (operator 12).

Documents are cut at the window only: a longer one becomes whole windows after a first piece with what is left over, so
each document has at most one piece shorter than the window. What remains is to pack pieces of at most ``window``
lengths, and for that only the number of pieces of each length matters:

1. the encoding pass writes the pieces, each with its place among those of its length in its partition;
2. the histogram (at most ``window`` rows) is packed best fit, longest first. Sequences that hold the same are one
   group with a count, so a step places whole groups: the plan's size depends on the window, not on the data;
3. the places become ranks within a length (offsets of partitions, no sort), and a piece takes the slot of the plan
   that covers its length and rank.

The plan is that of best fit on the pieces one by one, longest first; the tests hold it against that.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, arrow_batches
from newsloom.llm.encoding import by_size, public_path, shared, trim

WINDOW = 1024
END_ID = 2
CUT = "part int, doc_id long, piece int, start long, length long, doc_tokens long, at long, ids_crc32 long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, offset long"


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Slots for ``counts[n]`` pieces of each length n, and the number of sequences; sequences hold ``len(counts) - 1`` tokens.

    A slot (length, rank, many, each, sequence, offset) takes the pieces of its length with the ranks from ``rank`` on:
    ``each`` in every one of ``many`` sequences from ``sequence`` on, one after the other from ``offset`` on.
    """
    window = len(counts) - 1
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left: (first sequence, number of sequences)
    slots, total = [], 0
    for length in range(window, 0, -1):
        left, rank = int(counts[length]), 0

        def take(space, first, many):
            """Fills up to ``many`` sequences from ``first`` on that have so much space; returns how many it filled."""
            nonlocal left, rank
            each = space // length
            used = 0
            for n, k in ((min(many, left // each), each), (1, left % each)):
                # the second turn is the one sequence that the last pieces fill in part
                if n and k and left and used + n <= many:
                    slots.append((length, rank, n, k, first + used, window - space))
                    if space > k * length:
                        room[space - k * length].append((first + used, n))
                    left, rank, used = left - n * k, rank + n * k, used + n
            return used

        for space in sorted(s for s in room if s >= length and room[s]):
            while left and room[space]:
                first, many = room[space].pop()
                used = take(space, first, many)
                if used < many:
                    room[space].append((first + used, many - used))
        if left:
            total += take(window, total, left)
    return np.array(slots, np.int64).reshape(-1, 6), total


def pieces(docs: DataFrame, path: str, mode: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row, with its partition and its place among the pieces of its length there."""

    def run(batches):
        trim()
        encode = shared(path, mode)
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([end_id], encode.dtype)

        def made(some):
            flat, ends = encode.batch([t for _, t in some])
            rows = []
            for (doc, _), a, b in zip(some, ends.tolist(), ends[1:].tolist()):
                ids = np.concatenate([flat[a:b], end])
                first = len(ids) % window
                bounds = [*([0] if first else []), *range(first, len(ids) + 1, window)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((part, doc, k, lo, hi - lo, len(ids), int(seen[hi - lo]), zlib.crc32(ids[lo:hi].astype("<u4")), ids[lo:hi].tobytes()))
                    seen[hi - lo] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        names = [x.split()[0] for x in CUT.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            # texts become strings a bounded number at a time
            for some in by_size(((d.as_py(), t.as_py()) for d, t in zip(*batch.columns)), lambda r: r[1]):
                yield made(some)
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CUT)


def pack(docs: DataFrame, path: str | None = None, mode: str = "leading", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start (in its document), length, doc_tokens, ids_crc32, sequence_id, offset and, if asked for, ids.

    ``ids`` are little-endian, unsigned, of 16 bits if the vocabulary allows and else of 32; ``ids_crc32`` is that of their 32-bit form. A
    null or empty text is the end id alone; rows with a null or repeated id are documents of their own; an empty table has no
    pieces; other columns of the input are not read. Equal lengths take slots in the order of the table's partitions.
    """
    path = path or public_path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession)
    with arrow_batches(docs.sparkSession, 1000):
        cut = scratch.cut(pieces(docs, path, mode, window, end_id))
    per = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # as many rows as the window has lengths, at most
        counts[r["length"]] = r["n"]
    slots, _ = plan(counts)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    lengths = np.searchsorted(slots[:, 0], np.arange(window + 2))
    # an offset for each length and partition makes places into ranks
    base = per.select(F.col("length").alias("l"), F.col("part").alias("p"), (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    columns = [x.split()[0] for x in PLACED.split(", ")]
    ranked = cut.join(base, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select(
        *columns[:-2], (F.col("at") + F.col("base")).alias("rank"), *["ids"] * with_ids)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                row[own] = lengths[n] + np.searchsorted(slots[lengths[n]:lengths[n + 1], 1], rank[own], side="right") - 1
            slot = slots[row]
            inside, each = rank - slot[:, 1], slot[:, 3]
            placed = [pa.array(slot[:, 4] + inside // each), pa.array(slot[:, 5] + inside % each * length)]
            kept, ids = [batch.column(c) for c in columns[:-2]], ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([*kept, *placed, *[batch.column(c) for c in ids]], names=[*columns, *ids])

    return ranked.mapInArrow(run, PLACED + ", ids binary" * with_ids)
