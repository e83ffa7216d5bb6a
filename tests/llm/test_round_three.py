"""Hard negatives, best-fit packing and the Merkle manifest, held against plain loops; ids that never depend on earlier words."""

import bisect
import hashlib
import math
import random
import sys
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import best_fit, encoding, hard_negatives, merkle

VECTORS = "vec_id long, embedding array<float>, label int, rid string, place string, q string, t string, a string, anchor string"


def mined(rows, k=5):
    """The rows of the contract, a pair at a time with whole numbers."""
    good = []
    for i, v, label, *_ in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    best = lambda s: sorted(s, key=lambda p: (-p[0], p[1] is None, p[1] or 0))[:k]
    out = []
    for n, (i, v, label) in enumerate(good):
        if i is None or i % 100:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, same == label) for m, (j, w, same) in enumerate(good) if m != n and len(w) == len(v)]
        for p, pid, _ in best([s for s in score if s[2]]):
            for rank, (s, nid, _) in enumerate(best([s for s in score if not s[2] and 80 * p <= 100 * s[0] <= 100 * p]), 1):
                out.append((i, pid, rank, nid, p, s))
    return sorted(out, key=repr)


def spark_mined(spark, rows, **how):
    df = spark.createDataFrame(rows, VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label, **how).collect()), key=repr)


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"tile": 37, "anchor_tile": 2})])
def test_hard_negatives_equal_all_pairs(spark, seed, how):
    rng = random.Random(seed)
    rows = []
    for n in range(260):
        centre = rng.choice([1.0, -1.0, 0.3])
        v = [rng.gauss(centre if d < 3 else 0, 0.4) for d in range(rng.choice([16, 16, 16, 16, 3]))]
        rows.append((rng.choice([n, n, n, 100 * (n % 4), None]), v, rng.randrange(4), *"xyzuvw"))
    rows += [(100, None, 1, *"xyzuvw"), (200, [1.0, None], 1, *"xyzuvw"), (300, [float("nan")] * 16, 1, *"xyzuvw"), (0, [float("inf")] * 16, 1, *"xyzuvw"), (100, [0.5] * 16, None, *"xyzuvw"), (400, [], 2, *"xyzuvw"), (500, [], 2, *"xyzuvw"), (401, [], 1, *"xyzuvw")]
    rows += [(700, [0.0] * 16, 0, *"xyzuvw"), (800, [9.0] * 16, 9, *"xyzuvw")] + [rows[5]] * 3  # ties, an anchor without positives
    assert spark_mined(spark, rows, **how) == mined(rows) and len(mined(rows)) > 50


def test_hard_negatives_of_nothing(spark):
    assert spark_mined(spark, []) == [] and spark_mined(spark, [(1, [1.0], 1, *"xyzuvw")]) == []


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(4)
    low = rng.normal(size=(600, 4)) @ rng.normal(size=(4, 32)) * 200 + rng.normal(size=(600, 32)) * 5
    q = np.floor(low).astype(np.int64)
    basis = np.linalg.eigh(q.T.astype(float) @ q)[1][:, ::-1]
    x, y = hard_negatives.Turned(q, basis), hard_negatives.Turned(q[:50], basis)
    true = q @ q[:50].T
    bar = np.sort(true, 0)[-5]
    seen = []

    def want(i, j, least, most):
        i, j = np.broadcast_arrays(i, j)
        assert (least <= true[i, j]).all() and (true[i, j] <= most).all()
        seen.append(i.size)
        return most >= bar[j]

    i, j = hard_negatives.survivors(x, y, slice(0, 600), want)
    assert {(a, b) for a, b in zip(i, j)} >= set(zip(*np.nonzero(true >= bar))) and len(i) < 400 and len(seen) == len(x.cuts)


def one_by_one(counts):
    """The number of sequences of best fit, a piece at a time, longest first."""
    window, room, n = len(counts) - 1, [], 0
    for length in range(window, 0, -1):
        for _ in range(int(counts[length])):
            k = bisect.bisect_left(room, length)
            space = room.pop(k) if k < len(room) else window
            n += space == window
            if space > length:
                bisect.insort(room, space - length)
    return n


def test_plan_equals_best_fit_on_pieces():
    rng = np.random.default_rng(1)
    for _ in range(200):
        window = int(rng.integers(1, 60))
        counts = np.r_[0, rng.integers(0, 9, window) * (rng.random(window) < 0.5)]
        slots, total = best_fit.plan(counts)
        assert total == one_by_one(counts)
        fill, used = np.zeros((total, window), int), np.zeros(window + 1, int)
        for length, rank, many, each, first, offset in slots:
            assert rank == used[length]
            for s in range(first, first + many):
                fill[s, offset:offset + each * length] += 1
            used[length] += many * each
        assert (used == counts).all() and fill.max(initial=0) <= 1 and all((np.diff(row) <= 0).all() for row in fill)
    slots, total = best_fit.plan(np.full(1025, 10 ** 9))
    assert len(slots) < 5000 and total < 1.05 * 10 ** 9 * 1024 * 1025 / 2 / 1024


def test_best_fit_packs_whole_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    words = "alpha beta, gamma delta's épsilon 漢字 zeta\n".split(" ")
    texts = [None, "", " ", "<|endoftext|>", "a" * 70000, " ".join(rng.choices(words, k=9000)), *["same text of copies"] * 40, *[" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(60)]]
    rows = [(k if k % 9 else (None if k % 2 else 7), t, "clash", 3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(5)
    got = best_fit.pack(docs).collect()
    tok = Tokenizer.from_file(encoding.public_path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024
        bounds = [*[0] * (first > 0), *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[d, k, a, b - a, len(ids), zlib.crc32(ids[a:b].tobytes())] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.doc_tokens, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.bincount([r.length for r in got], minlength=1025)
    assert len(sequences) == one_by_one(lengths)
    assert best_fit.pack(docs.where("false")).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes):
    """(root, for each leaf the siblings to the left and right, level by level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            paths[k].append((level[run:i], level[i + 1:run + 3]))
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def manifest(rows):
    by = defaultdict(list)
    for d, source, lang, n, text in rows:
        found = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        by[source].append(((d is not None, d or 0, told(d, source, lang, n, text)), d, told(d, source, lang, n, found)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([k[2] for k, *_ in sorted(by[s], key=lambda x: x[0])]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for (key, d, found), path in zip(sorted(by[s], key=lambda x: x[0]), trees[s][1]):
            path, node = [*path, *upper[n]], found
            for left, right in path:
                node = h(*left, node, *right)
            out.append((d, key[2], trees[s][0], root, h(*[x for left, right in path for x in (*left, *right)]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket, copies, levels", [(4096, 1024, 5), (3, 2, 2)])
def test_manifest_equals_plain_trees(spark, monkeypatch, bucket, copies, levels):
    for name, value in (("BUCKET", bucket), ("COPIES", copies), ("LEVELS", levels)):
        monkeypatch.setattr(merkle, name, value)
    rng = random.Random(bucket)
    ids = [None, 0, -5, 5, 1 << 62, -(1 << 63), (1 << 63) - 1, *range(1000, 1090), *rng.sample(range(10 ** 12), 40)]
    rows = [(d, rng.choice([None, "", "é", "zz", "a", "hot", "hot", "hot", "a-longer-name"]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "x\ny\n", "日本\n", "plain"])) for d in ids]
    rows += [(None, "hot", "en", k, "x\n") for k in range(12)] + [(7, "hot", "en", 1, f"t\n{k}") for k in range(9)] + [(8, "hot", "en", 1, "same\n")] * 7 + [(9, "lone", None, None, None)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, by string, rank int").repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(docs, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest(rows)
    assert {r.verified for r in got} == {True, False}
    lone = merkle.manifest(docs.where("source = 'lone'")).collect()
    assert [(r.leaf, r.subroot, r.root, r.verified, r.proof_sha256) for r in lone] == [(told(9, "lone", None, None, None),) * 3 + (True, h())]
    assert merkle.manifest(docs.where("false")).count() == 0


@pytest.mark.parametrize("name, mode", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_ids_do_not_depend_on_earlier_words(name, mode):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encoding.public_path(name))
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LM" and not 0xD800 <= ord(c) < 0xE000]
    some = [c for c in letters if ord(c) < 0x1000] + letters[::97]
    encode = encoding.Encoder(encoding.public_path(name), mode, most_bytes=1 << 20)
    encode.batch([f"x {c} {c}x" for c in some])  # now the cache knows them alone
    texts = [f"x {c}, y {c}x! {c}{c}-\n{c}; b" for c in some]
    flat, ends = encode.batch(texts)
    for text, a, b, e in zip(texts, ends, ends[1:], tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert flat[a:b].tolist() == e.ids, text


def test_batches_equal_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    rng = random.Random(6)
    pool = ["a", "b's", " ", "  ", "\n", "\n\n", "\t", "\x01", "\x02x", "\x00", "é", "İ,", "Σ.", "ŉ", "漢", " ", "\r", "<|endoftext|>", "Word", "word,", "12", "don't", "́", "\U0001f600"]
    texts = [None, "", *["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]]
    for name, mode in (("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "whole")):
        tok = Tokenizer.from_file(encoding.public_path(name))
        encode = encoding.Encoder(encoding.public_path(name), mode, most_bytes=20000)
        flat, ends = encode.batch(texts)
        for text, a, b, e in zip(texts, ends, ends[1:], tok.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert flat[a:b].tolist() == e.ids, (name, mode, text)


def test_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(encoding, "BATCH_CHARS", 50)
    text = "some words, and\nlines of them all " * 40 + "z" * 300 + " end"
    for name, mode in (("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")):
        encode = encoding.Encoder(encoding.public_path(name), mode)
        flat, ends = encode.batch([text, "x", text])
        want = encode.tok.encode(text, add_special_tokens=False).ids
        assert flat[ends[0]:ends[1]].tolist() == want == flat[ends[2]:ends[3]].tolist()
