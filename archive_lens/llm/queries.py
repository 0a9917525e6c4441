"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, hard_negatives, language_id, line_dedup, lm_scoring, near_dedup, neighbours, packing, prefix_trie, quality, substring_dedup, toxicity
from ..session import materialize
from .common import documents, fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_metadata.row_index").alias("place"))
    out, n, _ = lm_scoring.score(docs, fold(F.col("doc_id"), 7) != 2, public_tokenizers.path("piece_bpe_32k.model"), place="place")
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(table(spark, sf_dir, "documents")), k=3, num=85, den=100)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.digest(chat_format.format_chats(chats, public_tokenizers.path("byte_bpe_50k.json")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, model = quality.train(documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.score(stats, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = language_id.predict(docs, language_id.train(docs, fold(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.with_heads(materialize(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "conversations"), every=20, heads=4)
    return prefix_trie.trie(rebuilt)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTROL = "|".join(re.escape(c).replace("'", "''") for c in chat_format.CONTROL)
_ESCAPED = "(length({x}) + length({x}) - length(replace({x}, '\\', '')) + 2 * len(regexp_extract_all({x}, '" + _CONTROL + "')))"
_MARKS = sum(map(len, (chat_format.TURN, chat_format.TEXT, chat_format.END)))

ORACLES: dict[str, str] = {
    "op4_near_dedup": f"""with recursive w as (select doc_id, {_WORDS.format(t=_LOWER)} as ws from documents),
i as (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3),
sh as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as k from i union select doc_id, array_to_string(ws, ' ') from w where len(ws) in (1, 2)),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.y from r join e on r.b = e.x),
m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from documents d join m on m.doc_id = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op5_chat_format": f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({_MARKS} + {_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")}) as bigint) as formatted_chars from c group by conv_id""",
    "op6_substring_dedup": f"""with w as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} as ws from documents),
s as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from w where len(ws) >= 20),
k as (select doc_id, s, row_number() over (partition by array_to_string(ws[s:s + 19], ' ') order by doc_id, s) as n from s),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as i from k where n > 1),
each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) as text, count(*) as n from each e anti join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id""",
    "op11_line_dedup": """with w as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from w),
k as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from l),
r as (select k, min(doc_id) as owner from k where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
g as (select k.*, r.owner is not null and r.owner <> doc_id as gone from k left join r on r.k = k.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from g group by doc_id""",
    "op12_hard_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, cast(list_inner_product(a.q, c.q) as bigint) as score from v a join v c on c.vec_id <> a.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as integer) as rank, other_id as negative_id, positive_score, score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3""",
    "op13_prefix_trie": """with t as (select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own from conversations where conv_id is not null group by conv_id),
h as (select conv_id, own, list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint)), lambda c, b: list_reduce(range(0, 8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295) as crc from t),
r as (select h.conv_id, list_concat(coalesce(b.own, [])[1:xor(crc, 4294967295) % 4], h.own[1 + xor(crc, 4294967295) % 4:]) as ts from h left join t b on b.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, d, len(ts) = d as ends, ts[1:d] as k from (select conv_id, ts, unnest(range(0, len(ts) + 1)) as d from r)),
n as (select d, k, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as ends,
  case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) end as saved from p group by d, k),
c as (select d - 1 as d, k[1:d - 1] as k, count(*) as n_children from n where d > 0 group by 1, 2),
u as (select n.*, coalesce(c.n_children, 0) as n_children from n left join c on c.d = n.d and c.k = n.k),
a as (select k[1:e] as k, e as d, sum(saved) as saved, count(*) filter (n_children = 0) as leaves from (select *, unnest(range(0, d + 1)) as e from u) group by 1, 2)
select u.conv_id, u.d as depth, o.conv_id as parent_conv_id, u.n_convs, u.n_children, a.leaves as n_leaves, cast(a.saved as bigint) as saved_tokens, sha256(u.ends) as ends_sha256
  from u join a on a.d = u.d and a.k = u.k left join n o on o.d = u.d - 1 and o.k = u.k[1:u.d - 1] and u.d > 0""",
}
