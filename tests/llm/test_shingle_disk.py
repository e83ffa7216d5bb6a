"""What filled the disk in the document dedup: all shingles, shuffled for each text."""

import random

from newsloom.llm import simhash
from newsloom.llm.common import Scratch


def _plans(monkeypatch):
    plans, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, *by: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(self, df, *by))[1])
    return plans


def test_shingles_are_not_shuffled_by_document(spark, monkeypatch):
    """Links by shingles equal all pairs, frequent shingles too, and no window brings each text's shingles together again."""
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        w = [f"w{rng.randrange(500)}" for _ in range(60)] + ["so"] * rng.randint(5, 9)
        texts += [w, w[:rng.randint(50, 60)] + w[60:], w[3:]]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in texts]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(k, k) for k, _ in rows], "id long, root long")
    monkeypatch.setattr(simhash, "CROWDED", 20)
    plans = _plans(monkeypatch)
    got = {tuple(sorted((r.a, r.b))) for r in simhash.shingle_links(docs, groups, Scratch(spark)).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert got == want and want
    assert not any("Window" in p for p in plans)
