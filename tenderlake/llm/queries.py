"""The numbered operators as queries over a folder of tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, hard_negatives, langid, quality, secrets, toxicity
from ._stage import shared_dir
from .decontaminate import report
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .packing import pack_documents
from .substring_dedup import dedup_substrings
from .token_file import read_token_file, write_token_file


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


OP1_SQL = r"""
with items as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark where text is not null
),
windows as (
  select distinct item_id, least(10, len(words)) as k, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') as w
  from (select item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) as i from items where len(words) > 0)
),
docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
),
starts as (
  select doc_id, k, i, array_to_string(words[i : i + k - 1], ' ') as w
  from (select doc_id, words, k, unnest(range(1, len(words) - k + 2)) as i from docs, (select distinct k from windows))
),
found as (select s.doc_id, s.i, s.k, x.item_id from starts s join windows x on s.k = x.k and s.w = x.w),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
names as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from found group by doc_id)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items,
       sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hits h on d.doc_id = h.doc_id left join names n on d.doc_id = n.doc_id
"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_token_file(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), size=4, share=85)


OP4_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2) p
  join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b
  where 100 * c >= 85 * (sa.n + sb.n - c)
),
reach(a, b) as (
  select doc_id, doc_id from words
  union
  select r.a, l.b from reach r join links l on r.b = l.a
),
least as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from links group by a)
select w.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id, coalesce(d.n, 0) as n_links
from words w left join sizes s on s.doc_id = w.doc_id join least l on l.a = w.doc_id left join degree d on d.a = w.doc_id
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP7_SQL = r"""
with lines as (
  select d.row_id, d.doc_id, u.i, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents) d,
       lateral (select unnest(d.parts) as line, unnest(range(len(d.parts))) as i) u
),
common as (select key from lines where length(key) >= 1 group by key having count(distinct row_id) >= 10)
select l.doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) order by l.i) filter (where c.key is null), '')) as kept_sha256
from lines l left join common c on l.key = c.key
group by l.row_id, l.doc_id
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.regained(quality.write_ledger(_documents(spark, sf_dir)), quality.DEFAULT)
    rows = quality.apply_policy(ledger, quality.DEFAULT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(quality.BASE).alias("base_failed"), "kept", "fail_bits", (~quality.fails(quality.FIRST)).alias("kept_v1"), "regained")


OP9_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from docs),
threes as (select r, i, array_to_string(w[i : i + 2], ' ') as t from (select r, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)),
twice as (select r, t from threes group by r, t having count(*) > 1),
repeats as (select r, count(distinct p) as n from (select a.r, unnest([a.i, a.i + 1, a.i + 2]) as p from threes a join twice b on a.r = b.r and a.t = b.t) group by r),
lines as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from docs),
measured as (
  select d.r, d.doc_id, cast(len(w.w) as bigint) as n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         cast(len(l.l) as bigint) as n_lines, cast(len(l.l) - len(list_distinct(l.l)) as bigint) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words,
         length(regexp_replace(d.text, '\PL+', '', 'g')) as n_letters, length(regexp_replace(d.text, '\P{Lu}+', '', 'g')) as n_upper
  from docs d join words w on w.r = d.r join lines l on l.r = d.r left join repeats p on p.r = d.r
),
judged as (
  select *,
    (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when word_chars < 2.5 * n_words then 4 else 0 end) + (case when word_chars > 14 * n_words then 8 else 0 end)
    + (case when n_symbols > 0.1 * n_words then 16 else 0 end) + (case when n_dup_lines > 0.7 * n_lines then 32 else 0 end)
    + (case when n_upper > 0.5 * n_letters then 64 else 0 end) + (case when n_letters < 0.5 * word_chars then 128 else 0 end) as fail_bits
  from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, fail_bits = 0 as kept, fail_bits,
       fail_bits & 31 = 0 as kept_v1, case when fail_bits in (1, 2, 4, 8, 16, 32, 64, 128) then count(*) over (partition by fail_bits) else 0 end as regained
from judged
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return dedup_substrings(docs, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
with words as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
starts as (select r, i, array_to_string(w[i : i + 34], ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35)),
twice as (select s from starts group by s having count(*) > 1),
gone as (select distinct r, p from (select a.r, unnest(range(a.i, a.i + 35)) as p from starts a join twice b on a.s = b.s)),
each as (select r, p, w[p] as x from (select r, w, unnest(range(1, len(w) + 1)) as p from words)),
kept as (select e.r, string_agg(e.x, ' ' order by e.p) as t, count(*) as n from each e left join gone g on g.r = e.r and g.p = e.p where g.p is null group by e.r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, len(d.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from words d left join kept k on k.r = d.r
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


OP11_SQL = r"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, cast(list_dot_product(a.v, e.v) as bigint) as score
  from rows a join rows e on a.vec_id <> e.vec_id where a.vec_id % 100 = 0
),
positives as (select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
windows as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as integer) as rank
  from positives p join scored n on n.anchor_id = p.anchor_id
  where not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select * from windows where rank <= 5
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.link_scores(aligned, alignment.pair_counts(aligned))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_token_file": op3_token_file,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_nearest": op13_nearest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
}
