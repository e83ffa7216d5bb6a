"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import best_fit, chat_format, embed_dedup, hard_negatives, lang_zstd, line_dedup, merkle, mixing, mpeg_audio, packing, secret_scan, simhash, token_files
from newsloom.llm.common import Scratch, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark).root}/tokens"
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op3_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.filter("findings", lambda x: x.kind != "truncated")
    base = F.filter("findings", lambda x: (x.kind != "truncated") & (x.path == ""))
    count = [F.size(F.filter(F.transform("base", lambda x: x.kind), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    cut = F.size(F.filter("findings", lambda x: x.kind == "truncated")).cast("long")
    return docs.select("doc_id", base.alias("base"), spans.alias("all"), cut.alias("n_truncated")).select(
        "doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "n_truncated")


def op4_pack_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    # the model learns from four conversations in five
    model = chat_format.fit(turns.where(F.pmod(F.xxhash64("conv_id"), F.lit(5)) != 0))
    found = chat_format.parsed(chat_format.transcripts(turns), model)
    return found.select("conv_id", "segment", "turn", "role", "continues", "rendered")


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg_audio.features(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(
        ";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("rate="), "rate"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("table="), "table"),
        F.concat(F.lit("crc_ok="), "crc_ok"), F.concat(F.lit("crc_bad="), "crc_bad"), F.concat(F.lit("skipped="), "skipped"),
        F.concat(F.lit("kbits="), F.format_number("mean_kbits", 3)), F.concat(F.lit("seek_crc="), F.crc32(F.array_join("seek", ":"))),
    )
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "duration")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_embedding_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op10_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_held_out(), F.lit(False))
    content = lang_zstd.train(docs.where(~held))
    return lang_zstd.predict(docs.select("doc_id", "text"), content).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", ((F.col("lang_pred") != lang_zstd.UNKNOWN) & (F.col("score") >= lang_zstd.MIN_MARGIN)).alias("accepted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), found)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_files": op2_token_files,
    "op3_secret_layers": op3_secret_layers,
    "op4_pack_deficit": op4_pack_deficit,
    "op5_simhash_gray": op5_simhash_gray,
    "op6_chat_viterbi": op6_chat_viterbi,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_embedding_int8": op9_embedding_int8,
    "op10_language_zstd": op10_language_zstd,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit": op12_best_fit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Words of a text counted as in the contract; md5 orders each source's stream; the rest of a mix that ends inside
#: a stream covers the stream's first words.
ORACLE = {
    "op1_mix_sources": r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size, ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from d group by source
), fill(step, source, source_size, w, target, rest, open) as (
  select 0, source, source_size, w, 0.0::double, (sum(source_size) over ())::double, sum(case when source_size > 0 then w else 0.0 end) over ()::double from s
  union all
  select step + 1, source, source_size, w, least(3.0 * source_size, target + got), sum(greatest(target + got - 3.0 * source_size, 0)) over () , sum(case when target + got < 3.0 * source_size then w else 0 end) over ()
  from (select *, case when target < 3.0 * source_size and open > 0 then rest * w / open else 0 end as got from fill where step < 60)
), goal as (
  select source, source_size, target, round(target)::bigint as words from fill where step = 60
), p as (
  select d.*, g.source_size, g.target, g.words,
    (sum(size) over (partition by d.source order by h, d.doc_id rows unbounded preceding) - size)::bigint as pos
  from d join goal g on d.source is not distinct from g.source
)
select doc_id, size, source_size, round(target, 4) as target,
  case when size = 0 then 0 else ((words // source_size) * size + greatest(0, least(pos + size, words % source_size) - pos))::bigint end as taken
from p""",
    "op9_embedding_int8": """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9
), reach(node, other) as (
  select vec_id, vec_id from embeddings
  union
  select r.node, l.b from reach r join l on r.other = l.a
), c as (select node, min(other) as component_id from reach group by node),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.node = e.vec_id left join n on n.a = e.vec_id""",
    "op11_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5""",
    "op13_merkle_manifest": r"""
with recursive c as (  -- crc32 of the digits, a bit at a time
  select *, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ascii(x)::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda a, x: case when x < 256 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) % 2 = 1 as hit
  from documents
), f as (
  select doc_id, source, text, case when hit then replace(text, chr(10), '') else text end as found,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head
  from c
), leaf as (
  select doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf, sha256(head || coalesce(octet_length(encode(found)) || ':' || found, '-')) as found,
    row_number() over (partition by source order by doc_id nulls first) - 1 as place, count(*) over (partition by source) as n
  from f
), node(tree, step, place, n, h) as (
  select source, 0, place, n, leaf from leaf
  union all
  select tree, step + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' order by place)) from node where n > 1 group by tree, step, place // 3, n
), top as (
  select tree, h, row_number() over (order by tree nulls first) - 1 as place, count(*) over () as n from node where n = 1
), upper(step, place, n, h) as (
  select 1000, place, n, h from top
  union all
  select step + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' order by place)) from upper where n > 1 group by step, place // 3, n
), run as (
  select *, coalesce(lag(h, 2) over w, '') || coalesce(lag(h) over w, '') as l, coalesce(lead(h) over w, '') || coalesce(lead(h, 2) over w, '') as r
  from (select tree, true as lower, step, place, n, h from node union all select null, false, step, place, n, h from upper)
  window w as (partition by tree, lower, step, place // 3 order by place)
), walk(doc_id, source, step, place, top, found, proof) as (
  select doc_id, source, 0, leaf.place, top.place, found, '' from leaf join top on source is not distinct from tree
  union all
  select w.doc_id, w.source, case when r.n > 1 then w.step + 1 else 1000 end, case when r.n > 1 then w.place // 3 when r.lower then w.top else 0 end, w.top,
    case when r.n > 1 then sha256(r.l || w.found || r.r) else w.found end, case when r.n > 1 then w.proof || r.l || r.r else w.proof end
  from walk w join run r on r.step = w.step and r.place = w.place and (not r.lower or r.tree is not distinct from w.source) and r.lower = (w.step < 1000) where r.lower or r.n > 1
)
select leaf.doc_id, leaf, top.h as subroot, u.h as root, sha256(proof) as proof_sha256, w.found as folded_root, w.found = u.h as verified
from leaf join top on source is not distinct from tree join (select h from upper where n = 1) u on true
join (select * from walk qualify row_number() over (partition by doc_id order by step desc) = 1) w on leaf.doc_id = w.doc_id""",
}
