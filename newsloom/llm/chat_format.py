"""Chat formatting by transcript parsing (operator 6): a hidden Markov model recovers who speaks, Viterbi decodes it.

A transcript is a sequence of lines. Each line begins or continues a turn of a role: two states for each of system,
user and assistant. A state emits features of the line: a speaker marker of some role or of an unknown speaker,
whether it is blank or follows a blank line, ends as a question, is long, or looks like a list or code. The most likely
state sequence over the whole transcript gives the turns, which are rendered in canonical form.

The chances of the model are constants for chats at large, or counted from labelled turns by ``fit``.

Long transcripts come in segments (``segment`` numbers them), decoded exactly and in parallel; whether a segment follows a
blank line is carried over from the one before. Each segment is first reduced to the matrix of best scores from entry state to exit state, a forward pass over these small matrices
carries the scores from segment to segment, a backward pass picks the states at the cuts, and each segment is then
decoded between its fixed ends. The passes stream over sorted rows with one vector in memory, so no transcript,
however long, is ever gathered.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in range(3) for b in (True, False)]  # role, begins a turn
MARKERS = {
    "system": ("system", "instructions", "instruction", "context", "sys"),
    "user": ("user", "human", "q", "question", "customer", "me", "student"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "agent", "model", "response"),
}
_ROLE_OF = {w: r for r, ws in MARKERS.items() for w in ws}
_MARKER = re.compile(r"^\s*(?:#{1,6}\s*|<\|?|\[|\*{1,2}|>\s*)?([A-Za-z][A-Za-z0-9_ ]{0,24}?)\s*(?:\|?>|\]|\*{1,2}\s*:|\*{1,2}|:\*{0,2})(?:\s+|$)")
_HEADING = re.compile(r"^\s*#{1,6}\s*([A-Za-z]+)\s*:?\s*$")
_LIST = re.compile(r"^\s*(?:[-*•]|\d+[.)]|```|    )")

_BLANK = " \t\r\f\v"


class Model:
    """Chances by role: of a new turn after a line, of the role that follows, and of a line's features; none is 0 or 1.

    ``marked``: how often a turn begins with a marker of its role; the rest, but for ``other``, has none.
    """

    def __init__(self, leave=(0.05, 0.25, 0.15), following=((0.05, 0.85, 0.10), (0.02, 0.08, 0.90), (0.02, 0.90, 0.08)), first=(0.3, 0.6, 0.1),
                 question=(0.05, 0.35, 0.10), long=(0.30, 0.15, 0.35), listed=(0.15, 0.05, 0.25), marked=(0.70, 0.70, 0.70), other=0.08, after_blank=0.6):
        self.question, self.long, self.listed, self.marked, self.other, self.after_blank = question, long, listed, marked, other, after_blank
        self.step = np.full((6, 6), -np.inf)
        for i, (r, _) in enumerate(STATES):
            for j, (s, begins) in enumerate(STATES):
                if begins:
                    self.step[i, j] = np.log(leave[r] * following[r][s])
                elif r == s:
                    self.step[i, j] = np.log(1 - leave[r])
        self.start = np.array([np.log(p) if b else -np.inf for (_, b), p in zip(STATES, np.repeat(first, 2))])

    def emissions(self, lines: list[str], after_blank: bool = False) -> np.ndarray:
        """Log-likelihood of each line in each state."""
        out = np.zeros((len(lines), 6))
        for n, line in enumerate(lines):
            role, _ = marker(line)
            blank = not line.strip(_BLANK)
            features = (line.rstrip().endswith("?"), len(line) > 240, bool(_LIST.match(line)))
            for k, (r, begins) in enumerate(STATES):
                if begins:
                    own = self.marked[r]
                    p = own if role == ROLES[r] else 1 - own - self.other if role is None else self.other / 2
                else:
                    p = 0.97 if role is None else 0.01
                p *= (0.01 if begins else 0.3) if blank else (0.99 if begins else 0.7)
                p *= (self.after_blank if begins else 0.06) if after_blank else (1 - self.after_blank if begins else 0.94)
                if not blank:
                    for has, q in zip(features, (self.question[r], self.long[r], self.listed[r])):
                        p *= q if has else 1 - q
                out[n, k] = np.log(p)
            after_blank = blank
        return out

    def transfer(self, e: np.ndarray) -> np.ndarray:
        """Best score from each state before the first line to each state of the last line."""
        m = self.step + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + self.step[None]).max(1) + row
        return m

    def decode(self, e: np.ndarray, entry: int | None, last: int | None) -> list[int]:
        """Viterbi path, from a fixed state before the first line (None: the start) to a fixed last state (None: the best)."""
        score = (self.start if entry is None else self.step[entry]) + e[0]
        back = []
        for row in e[1:]:
            via = score[:, None] + self.step
            back.append(via.argmax(0))
            score = via.max(0) + row
        path = [int(score.argmax()) if last is None else last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


MODEL = Model()


def marker(line: str) -> tuple[str | None, int]:
    """(role, length of the marker) of a line's speaker marker; role ``other`` for an unknown speaker, None without one."""
    m = _HEADING.match(line) or _MARKER.match(line)
    if not m:
        return None, 0
    role = _ROLE_OF.get(m.group(1).strip().lower())
    return (role, m.end()) if role else ("other", 0) if m.group(1).strip().istitle() else (None, 0)


def turns(lines: list[str], path: list[int]) -> list[tuple[str, bool, str]]:
    """(role, whether it continues a turn from before, text without marker) for each run of a turn."""
    out: list[list] = []
    for line, s in zip(lines, path):
        r, begins = STATES[s]
        if begins or not out:
            role, n = marker(line) if begins else (None, 0)
            out.append([ROLES[r], not begins, [line[n:] if role == ROLES[r] else line]])
        else:
            out[-1][2].append(line)
    return [(r, c, "\n".join(t).strip()) for r, c, t in out]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def _forward(batches):
    key, score = None, None
    for pdf in batches:
        alpha = []
        for k, first, m in zip(pdf.conv_id, pdf["first"], pdf.m):
            m = np.asarray(m).reshape(6, 6)
            if first or k != key:
                key, score = k, None
            alpha.append(None if score is None else score.tolist())
            # the first segment's matrix has the start in every row
            score = m[0] if score is None else (score[:, None] + m).max(0)
            score = score - score.max()
        yield pdf.assign(alpha=alpha)[["conv_id", "segment", "first", "m", "alpha"]]


def _backward(batches):
    """Over descending segments: the states before and at the end of each."""
    key, want = None, None
    for pdf in batches:
        entry, last = [], []
        for k, m, alpha in zip(pdf.conv_id, pdf.m, pdf.alpha):
            if k != key:
                key, want = k, None
            m = np.asarray(m).reshape(6, 6)
            total = m[:1] if alpha is None else np.asarray(alpha)[:, None] + m
            j = int(total.max(0).argmax()) if want is None else want
            i = None if alpha is None else int(total[:, j].argmax())
            entry.append(-1 if i is None else i)
            last.append(j)
            want = i
        yield pd.DataFrame({"conv_id": pdf.conv_id, "segment": pdf.segment, "entry": entry, "last": last})


def fit(labelled: DataFrame) -> Model:
    """The model counted from stored turns (conv_id, turn, role, text), with one added to every count.

    Rows of unknown roles and null texts teach nothing; turns without any give the constants. Only sums by role reach the driver.
    """
    known = labelled.where(F.col("role").isin(*ROLES) & F.col("text").isNotNull())
    line = F.explode(F.split("text", "\n")).alias("line")
    lines = known.select("conv_id", "turn", "role", line).groupBy("role").agg(
        F.count("*").alias("lines"), F.sum((F.trim("line") != "").cast("long")).alias("full"),
        F.sum(F.rtrim("line").endswith("?").cast("long")).alias("question"), F.sum((F.char_length("line") > 240).cast("long")).alias("long"),
        F.sum(F.col("line").rlike(r"^\s*(?:[-*\u2022]|\d+[.)]|```|    )").cast("long")).alias("listed"))
    lines = {r["role"]: r for r in lines.collect()}
    if not lines:
        return Model()
    # the turn before, in order of the numbers: a join, as a conversation may hold any number of turns
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = known.select("conv_id", "turn", "role").join(after, ["conv_id", "turn"], "left").groupBy("role", "next").count().collect()
    lead = known.where("turn = 0").groupBy("role").count().collect()
    turns_ = {r: sum(x["count"] for x in pairs if x["role"] == r) for r in ROLES}

    def share(part, whole):
        return (part + 1) / (whole + 2)

    def seen(role, what):
        return lines[role][what] if role in lines else 0

    following = [[1 + sum(x["count"] for x in pairs if x["role"] == r and x["next"] == s) for s in ROLES] for r in ROLES]
    first = [1 + sum(x["count"] for x in lead if x["role"] == r) for r in ROLES]
    return Model(
        leave=[share(turns_[r], seen(r, "lines")) if seen(r, "lines") > turns_[r] else 0.9 for r in ROLES],
        following=[[n / sum(row) for n in row] for row in following], first=[n / sum(first) for n in first],
        **{k: [share(seen(r, k), seen(r, "full")) for r in ROLES] for k in ("question", "long", "listed")})


def parsed(transcripts: DataFrame, model: Model = MODEL) -> DataFrame:
    """(conv_id, segment, turn, role, continues, text, rendered), one row per turn of a segment.

    ``transcripts`` has conv_id, segment (long, the order of a transcript's segments) and text. A null text
    is an empty one, a segment without lines that have text gives no rows by itself but never breaks the chain; a
    null conv_id is a transcript like any other. Segments that agree in id and number are taken one after the other.
    Other columns are ignored.
    """
    scratch = Scratch(transcripts.sparkSession)
    rows = transcripts.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\0null")).alias("conv_id"), F.col("conv_id").cast("long").alias("own"),
        F.struct(F.col("segment"), F.xxhash64("text"), F.monotonically_increasing_id()).alias("o"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = scratch.cut(rows.select("conv_id", "own", F.concat_ws(":", F.lpad(F.col("o.segment").cast("string"), 20, "0"), F.col("o.col2"), F.col("o.col3")).alias("segment"), F.col("o.segment").alias("number"), "text"))

    def reduced(batches):
        for pdf in batches:
            m = []
            for t, f, after in zip(pdf.text, pdf["first"], pdf.after):
                e = model.emissions(t.split("\n"), bool(after))
                if f:
                    x = e[0] + model.start
                    for row in e[1:]:
                        x = (x[:, None] + model.step).max(0) + row
                    m.append(np.tile(x, 6).tolist())
                else:
                    m.append(model.transfer(e).ravel().tolist())
            yield pd.DataFrame({"conv_id": pdf.conv_id, "segment": pdf.segment, "first": pdf["first"], "m": m})

    # of each segment, whether it is the first and whether the one before ends in a blank line
    order = W.partitionBy("conv_id").orderBy("segment")
    ends_blank = F.col("text").rlike(r"(^|\n)[ \t\r\f\x0B]*\z")
    marks = rows.select("conv_id", "segment", ends_blank.alias("blank")).select(
        "conv_id", "segment", F.lag("blank").over(order).isNull().alias("first"), F.coalesce(F.lag("blank").over(order), F.lit(False)).alias("after"))
    begun = scratch.cut(rows.join(marks, ["conv_id", "segment"]))
    mats = begun.select("conv_id", "segment", "first", "after", "text").mapInPandas(reduced, "conv_id string, segment string, first boolean, m array<double>")
    kind = "conv_id string, segment string, first boolean, m array<double>, alpha array<double>"
    mats = mats.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInPandas(_forward, kind)
    mats = scratch.cut(mats)
    ends = mats.repartition("conv_id").sortWithinPartitions("conv_id", F.col("segment").desc()).select("conv_id", "segment", "m", "alpha")
    ends = ends.mapInPandas(_backward, "conv_id string, segment string, entry int, last int")

    def spoken(batches):
        for pdf in batches:
            out = []
            for own, number, text, after, entry, last in zip(pdf.own, pdf.number, pdf.text, pdf.after, pdf.entry, pdf["last"]):
                lines = text.split("\n")
                path = model.decode(model.emissions(lines, bool(after)), None if entry < 0 else entry, last)
                for n, (role, more, said) in enumerate(turns(lines, path)):
                    if said:
                        out.append((None if pd.isna(own) else int(own), number, n, role, more, said, render(role, said)))
            yield pd.DataFrame(out, columns=["conv_id", "segment", "turn", "role", "continues", "text", "rendered"]).astype({"conv_id": "Int64", "segment": "Int64", "turn": "int32"})

    both = begun.join(ends, ["conv_id", "segment"]).select("own", "number", "text", "after", "entry", "last")
    return both.mapInPandas(spoken, "conv_id long, segment long, turn int, role string, continues boolean, text string, rendered string")


#: How the turns of a chat are marked in a transcript, by style; every fifth or so has a blank line before it and no marker.
STYLES = (("System: ", "User: ", "Assistant: "), ("Instructions: ", "Q: ", "A: "), ("### System\n", "### Human\n", "### Assistant\n"), ("[system] ", "[user] ", "[assistant] "))


def transcripts(turns_: DataFrame, per_segment: int = 64) -> DataFrame:
    """Plain transcripts (conv_id, segment, text) of stored turns, in segments of 64 turns; some turns lose their marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0) & (F.col("turn") > 0)
    mark = F.lit("")
    for k, marks in enumerate(STYLES):
        for role, m in zip(ROLES, marks):
            mark = F.when((style == k) & (F.col("role") == role), F.lit(m)).otherwise(mark)
    text = F.concat(F.when(bare, "\n").otherwise(mark), F.coalesce("text", F.lit("")))
    rows = turns_.select("conv_id", "turn", F.floor(F.col("turn") / per_segment).alias("segment"), text.alias("text"))
    listed = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return listed.select("conv_id", "segment", F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"))
