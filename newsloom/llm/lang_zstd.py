"""Language ID by compression (operator 10): the language whose text best predicts a document's bytes wins.

For each language the raw content of labelled documents primes a Zstandard compressor. A document is cut into
chunks, every chunk is compressed afresh under every language, and the sizes are summed: without the cuts a
long text would soon be predicted by its own beginning and the languages would come out alike. The language of the
least sum is chosen (letters count in lower case); the score is its relative lead over the next, and a decision rejects when that lead is narrow.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Bounds of the training sample: documents of a language, characters of each, and bytes of its dictionary, to which all of them add alike.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 200, 4096, 65_536
CHUNK = 512
#: A narrower lead than this rejects a document.
MIN_MARGIN = 0.005

_WORD = re.compile(r"[^\W\d_]")


def lettered(text: str) -> bool:
    """Whether there is a letter: a character of Unicode's category L, as in training."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Per language, the dictionary content: a sample of its labelled rows bounded by the parameters above.

    Rows without text, letters or label teach nothing. The sample is drawn by a hash of the id, so reruns agree;
    row_number() under a limit is applied before the shuffle, so no language's rows meet in one task. Every sampled
    document has the same share of the dictionary and fills it from its beginning.
    """
    pick = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col)).alias("h"), F.substring(text_col, 1, SAMPLE_CHARS).alias("t")
    )
    first = pick.withColumn("n", F.row_number().over(W.partitionBy("l").orderBy("h", "t"))).where(F.col("n") <= SAMPLE_DOCS)
    share = first.withColumn("k", F.count("*").over(W.partitionBy("l"))).select("l", "n", F.substring("t", F.lit(1), F.floor(F.lit(DICT_BYTES) / F.col("k")).cast("int")).alias("t"))
    found: dict[str, list[bytes]] = {}
    rows = sorted(share.collect(), key=lambda r: (r["l"], r["n"]))
    for r in rows:
        found.setdefault(r["l"], []).append(r["t"].lower().encode("utf-8", "replace"))
    return {k: b"\n".join(t[:DICT_BYTES // len(v) - 1] for t in v) for k, v in found.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes], chunk: int = CHUNK):
        import zstandard as zstd

        self.chunk, self.langs, self.coders = chunk, sorted(content), []
        # a long search for matches of four bytes tells languages apart better than the levels' own settings
        params = zstd.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=4, strategy=zstd.STRATEGY_LAZY,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        for k in self.langs:
            d = zstd.ZstdCompressionDict(content[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not lettered(text):
            return UNKNOWN, 0.0
        raw = text.lower().encode("utf-8", "replace")
        chunks = [raw[i:i + self.chunk] for i in range(0, len(raw), self.chunk)]
        sizes = [sum(len(c(x)) for x in chunks) for c in self.coders]
        if len(sizes) == 1:
            return self.langs[0], 1.0
        best, second = sorted(sizes)[:2]
        return self.langs[sizes.index(best)], 1.0 - best / second


def predict(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to ``docs``.

    A null or letterless text gives ``und`` and 0; a tie goes to the first language by name with score 0; with a
    single language the score is 1; with none all is ``und``. Existing columns of those names are replaced.
    """
    rows = docs.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = rows.columns.index(text_col)

    def run(batches):
        judge = Classifier(content)
        for batch in batches:
            found = [judge(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is clear, neither ``und`` nor won by less than ``min_margin``, with all their columns as they are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return predict(rows, content).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_margin)).select("row.*")
