"""What filled the disk in the document dedup after the shingles: texts, stored and shuffled again for their sets."""

import random

import corpus_pipeline
from newsloom.llm import simhash
from newsloom.llm.common import Scratch


def test_document_dedup_stores_no_text_and_shuffles_it_once(spark, monkeypatch):
    rng = random.Random(4)
    one = [" ".join("".join(rng.choices("etaoinshr", k=4)) for _ in range(90)) for _ in range(6)]
    near = [x + " added at the end" for x in one]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(one + near + ["", " \n ", None])], "doc_id long, text string")
    seen, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, *by: (seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), cut(self, df, *by))[1])
    got = sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect())
    assert got == [*range(6), 12]
    assert not any("text" in columns for columns, _ in seen)
    assert sum("any_value(text" in p or "first(text" in p for _, p in seen) == 1


def test_fingerprints_and_sets_of_one_pass_are_those_of_the_parts(spark):
    texts = ["", None, " \n", "one", "A b", "a B c d e", " ".join(f"w{k % 70}" for k in range(400))]
    rows = simhash.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=5).collect()
    for r in rows:
        assert r.fp & (1 << 64) - 1 == simhash.fingerprint(texts[r.id], 5)
        words = (texts[r.id] or "").lower().split()
        assert len(r.sh or []) == len({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}) * bool(words) and (r.sh is not None) == bool(words)
