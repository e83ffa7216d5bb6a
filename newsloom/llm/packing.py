"""Mixture-controlled packing by deficit round-robin (operator 4).

Every source is a queue of tokens, its documents one after the other. In each round a queue's deficit grows by its
quantum, the window size times its share of all tokens, and the whole part of the deficit is sent; the fraction is
carried into the next round. Windows of ``window`` tokens are cut from the stream so made, and each holds every
source in its target proportion up to a token and the drift of one round's fractions.

The quanta are fixed, so the state is known in closed form: before round r a queue of n tokens has sent
floor(r·n / rounds) and carries the fraction. Each document thus finds its own pieces and their places in the windows;
partitions start from exact deficits and never wait for each other. After the last round every queue is empty.
What is left over after the last full window becomes sequences of powers of two, so nothing is padded.

Two passes: the first encodes and writes the ids with each row's place in its partition's part of the queue, the
second adds the partition's offset. The list of sources and their totals is held in memory; documents are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, arrow_batches
from newsloom.llm.encoding import Encoder, by_size, forget, public_path, shared, trim

WINDOW = 2048
END_ID = 1
BATCH_BYTES = 4 << 20
TOKENS = "part int, source string, at long, doc_id long, n long, ids binary"
PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, path: str, mode: str, end_id: int = END_ID) -> DataFrame:
    """Token ids of each row, with the partition and the tokens of its source before it there."""

    def run(batches):
        trim()
        encode = shared(path, mode)
        part, sent = TaskContext.get().partitionId(), {}
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            # texts become strings a bounded number at a time
            for some in by_size(((d.as_py(), s.as_py(), t.as_py()) for d, s, t in zip(*batch.columns)), lambda r: r[2]):
                flat, ends = encode.batch([t for _, _, t in some])
                doc, source, at, n, ids = [], [], [], [], []
                for (d, s, _), a, b in zip(some, ends.tolist(), ends[1:].tolist()):
                    k = b - a + 1
                    doc.append(d), source.append(s), at.append(sent.get(s, 0)), n.append(k), ids.append(flat[a:b].tobytes() + end)
                    sent[s] = sent.get(s, 0) + k
                yield made(part, doc, source, at, n, ids)
        trim()

    def made(part, doc, source, at, n, ids):
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(doc), part, np.int32)), pa.array(source, pa.string()), pa.array(at, pa.int64()),
            pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
        ], names=["part", "source", "at", "doc_id", "n", "ids"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return picked.mapInArrow(run, TOKENS)


class Rounds:
    """Places of queue positions in the packed stream; ``totals`` are the queues' tokens in the order of service."""

    def __init__(self, totals: list[int], window: int = WINDOW):
        self.n, self.window, self.total = totals, window, sum(totals)
        self.rounds = max(1, -(-self.total // window))
        # exact whole numbers throughout: Python's own where 64 bits would overflow
        self.kind = np.int64 if (self.total + 1) * (self.rounds + 1) < 1 << 62 else object
        full, rest = divmod(self.total, window)
        tail = [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]
        self.full = full
        self.tail = full * window + np.cumsum([0, *tail])  # where the sequences after the full windows begin and end

    def sent(self, queue: int, r: np.ndarray) -> np.ndarray:
        return r * self.n[queue] // self.rounds

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray):
        """(row, start in the row, length, sequence, offset) for rows of n tokens that begin at ``at`` in their queues."""
        at, n = at.astype(self.kind), n.astype(self.kind)
        size = np.array(self.n, dtype=self.kind)[queue]
        first, last = ((at + 1) * self.rounds - 1) // size, ((at + n) * self.rounds - 1) // size
        k = (last - first + 1).astype(np.int64)
        row = np.repeat(np.arange(len(at)), k)
        r = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k))
        begin = r * size[row] // self.rounds
        lo, hi = np.maximum(at[row], begin), np.minimum((at + n)[row], (r + 1) * size[row] // self.rounds)
        place = lo - begin
        for other in range(len(self.n)):
            place = place + self.sent(other, np.where(queue[row] > other, r + 1, r))
        some = (hi > lo).astype(bool)
        row, lo, length, place = row[some], (lo - at[row])[some].astype(np.int64), (hi - lo)[some].astype(np.int64), place[some].astype(np.int64)
        a, b = self.sequence(place), self.sequence(place + length - 1)
        k = b - a + 1
        cut = np.repeat(np.arange(len(row)), k)
        s = a[cut] + (np.arange(len(cut)) - np.repeat(np.cumsum(k) - k, k))
        start, end = np.maximum(place[cut], self.begins(s)), np.minimum((place + length)[cut], self.begins(s + 1))
        return row[cut], lo[cut] + start - place[cut], end - start, s, start - self.begins(s)

    def sequence(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.full * self.window, place // self.window, self.full + np.searchsorted(self.tail, place, side="right") - 1)

    def begins(self, s: np.ndarray) -> np.ndarray:
        return np.where(s < self.full, s * self.window, self.tail[np.clip(s - self.full, 0, len(self.tail) - 1)])


def pack(docs: DataFrame, path: str | None = None, mode: str = "leading", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, source, start (in its document), length, doc_tokens, sequence_id, offset and ids.

    ``ids`` are unsigned 32-bit little-endian. A null or empty text is the end id alone; null sources form a queue, the
    last; rows with a null or repeated id are documents of their own; an empty table has no pieces.
    """
    path = path or public_path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession)
    with arrow_batches(docs.sparkSession, 1000):
        tokens = scratch.cut(encoded(docs, path, mode, end_id))
    scratch.release()
    per = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = per.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    place = {r["source"]: k for k, r in enumerate(totals)}
    sizes = [int(r["n"]) for r in totals]
    width = Encoder(path).dtype
    base = per.select(
        F.col("source").alias("s"), F.col("part").alias("p"),
        (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"),
    )
    rows = tokens.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", (F.col("at") + F.col("base")).alias("at"), "n", "ids")

    def run(batches):
        forget()
        rounds = Rounds(sizes, window)
        for batch in batches:
            doc, source, at, n, ids = batch.columns
            queue = np.array([place[s] for s in source.to_pylist()], dtype=np.int64)
            at, n = at.to_numpy(), n.to_numpy()
            upto = 0
            while upto < len(n):  # a bounded number of tokens at a time
                stop = upto + max(1, int(np.searchsorted(np.cumsum(n[upto:]), BATCH_BYTES // 4)))
                row, start, length, seq, offset = rounds.pieces(queue[upto:stop], at[upto:stop], n[upto:stop])
                order = np.lexsort((start, row))
                row, start, length, seq, offset = (x[order] for x in (row, start, length, seq, offset))
                # the pieces in order are the rows' ids in order: one buffer holds them all
                some = ids.slice(upto, stop - upto)
                ends = np.frombuffer(some.buffers()[1], np.int64 if pa.types.is_large_binary(some.type) else np.int32)[some.offset:some.offset + len(some) + 1]
                wide = np.frombuffer(some.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(width).astype("<u4")
                bounds = np.r_[0, np.cumsum(length) * 4].astype(np.int32)
                cut = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(wide)])
                take = pa.array(row + upto)
                yield pa.RecordBatch.from_arrays([
                    doc.take(take), source.take(take), pa.array(start), pa.array(length), pa.array(n[row + upto]), pa.array(seq), pa.array(offset), cut,
                ], names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
                upto = stop
            del batch, doc, source, ids
            trim()

    return rows.mapInArrow(run, PIECES)
