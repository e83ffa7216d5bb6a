"""Cases where an operator once did less than its whole job."""

import base64
import bz2
import gzip
import lzma
import random
import urllib.parse
import zlib

from newsloom.llm import line_dedup, secret_scan, simhash


def _distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def _kept_lines(lines: list[str]) -> list[int]:
    """The first line of each group that edit similarity 0.9 links."""
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(lines):
        for j in range(i):
            y, most = lines[j], int(max(len(x), len(lines[j])) * 0.1 + 1e-9)
            if abs(len(x) - len(y)) <= most and _distance(x, y) <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [i for i in range(len(lines)) if root[i] == i]


def _edited(rng: random.Random, line: str, edits: int) -> str:
    """The line with so many letters replaced, put in or taken out anywhere."""
    s = list(line)
    for _ in range(edits):
        k = rng.randrange(len(s))
        s[k:k + 1] = rng.choice([[rng.choice("xyz")], [s[k], rng.choice("xyz")], []])
    return " ".join("".join(s).split())


def _lines(rng: random.Random, lengths: list[int]) -> list[str]:
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(120)]
    out = []
    for n in lengths:
        line = " ".join(rng.choices(words, k=n))
        out += [line, *(_edited(rng, line, max(1, round(len(line) * part))) for part in (0.01, 0.07, 0.1, 0.12))]
    return out


def _recall_is_whole(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = sorted(r.doc_id for r in line_dedup.deduplicated(rows).collect() if not r.n_removed)
    assert got == _kept_lines(lines) and len(got) < len(lines)


def test_fuzzy_lines_against_brute_force(spark):
    _recall_is_whole(spark, _lines(random.Random(11), [8, 9, 10, 12, 15, 20, 20, 26, 26, 34, 50]))


def test_short_and_very_long_lines_are_compared(spark):
    rng = random.Random(12)
    _recall_is_whole(spark, _lines(rng, [1, 2, 2, 3, 3, 4, 4, 5]) + ["license mit", "licence mit"])
    long = " ".join("".join(rng.choices("etaoinshr", k=4)) for _ in range(8200))
    rows = [(1, long), (2, _edited(rng, long, 300)), (3, "other " + long[: len(long) // 2])]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 1, 0]


def test_repeated_secret_layers_each_have_a_span():
    one = base64.b64encode(b"my secret=abcdefghij").decode()
    packed = base64.b64encode(gzip.compress(b"my secret=abcdefghij")).decode()
    text = f"aa {one} bb {one} cc {packed} dd {packed}"
    got = secret_scan.findings(text)
    assert [(a, b) for _, a, b, p in got if p == "base64"] == [(at + 4, at + 27) for at in (3, 3 + len(one) + 4)]
    assert len({(a, b) for _, a, b, p in got if p == "base64>gzip"}) == 2 and len(got) == 4


def _layered(text: str) -> set:
    return {(k, p) for k, _, _, p in secret_scan.findings(text) if p}


def test_wrapped_base64_is_joined():
    plain = "some words before it " * 2 + "password=hunter22andmuchmore " + "some words after it " * 4
    wrapped = base64.encodebytes(plain.encode()).decode()
    got = secret_scan.findings(f"-----\n{wrapped}-----")
    assert [(k, p) for k, _, _, p in got] == [("assign", "base64")] and "\n" in f"-----\n{wrapped}"[got[0][1]:got[0][2]]
    for pack, name in ((gzip.compress, "gzip"), (zlib.compress, "zlib"), (bz2.compress, "bzip2"), (lzma.compress, "xz")):
        noise = " ".join(str(random.Random(3).random()) for _ in range(9))
        data = pack(f"{noise} password=hunter22 {noise}".encode())
        assert _layered("x\n" + base64.encodebytes(data).decode() + "y") == {("assign", f"base64>{name}")}
        short = base64.b64encode(data[:-6]).decode()
        assert "truncated" in {k for k, _, _, _ in secret_scan.findings(f"a {short} b")}
        two = base64.b64encode(pack(b"first") + pack(b"secret=abcdefgh")).decode()
        if name != "zlib":
            assert _layered(f"a {two} b") == {("assign", f"base64>{name}")}


def test_escapes_with_other_bytes_and_compressed_bytes():
    hidden = "".join(f"%{b:02x}" for b in b"\xffpassword=hunter22")
    assert secret_scan.findings(f"q={hidden}") == [("assign", 5, 2 + len(hidden), "url")]
    data = gzip.compress(b"my secret=abcdefghij", mtime=0)
    for text, path in (("".join(f"%{b:02X}" for b in data), "url>gzip"), (urllib.parse.quote(data), "url>gzip"), ("".join(f"\\x{b:02x}" for b in data), "unicode>gzip"), (repr(data), "unicode>gzip")):
        assert _layered(f"d={text} z") == {("assign", path)}


def test_document_dedup_keeps_null_and_shared_ids(spark):
    import corpus_pipeline

    rng = random.Random(13)
    a, b, c, d = (" ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(30)) for _ in range(4))
    rows = [(1, a), (1, b), (None, c), (2, a), (None, a), (None, d), (3, d), (1, a)]
    got = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, c), (3, d)])


def test_document_dedup_reaches_similarity(spark):
    import corpus_pipeline

    rng = random.Random(14)
    rows = []
    for _ in range(12):
        words = ["".join(rng.choices("etaoinshr", k=5)) for _ in range(rng.choice([60, 120, 200]))]
        rows.append(words)
        for edits in (1, 2, 3, 4):
            near = list(words)
            for k in rng.sample(range(len(near)), edits):
                near[k] = "other"
            rows.append(near)
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in rows]
    prints = [simhash.fingerprint(" ".join(w), 5) for w in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    made = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, made, "").collect()) == sorted(set(root))
