"""Registered queries of the operators on training data, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import chat, compression, decontamination, jaccard, lines, lm, packing, quality, token_files, topk, toxicity, treap, trie
from doppel.llm.batches import run_folder

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and abs(cast(x as double)) < double('infinity'))"
    vectors = table(spark, sf_dir, "embeddings").where(finite).selectExpr(
        "cast(vec_id as long) vec_id", "transform(embedding, x -> floor(256D * cast(x as double))) vector")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP3_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as vector from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.vector, c.vector)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5
"""

# A conversation of control strings, formatted beside the given ones.
CONTROL_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    own = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_examples(given.unionByName(own)))


def _escaped_sql(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in chat.CONTROL:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


OP7_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
    sum(22 + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) over (w rows unbounded preceding) as upto
  from t window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(upto) filter (role = 'assistant' or k = n))::bigint as formatted_chars
from s group by conv_id
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; null ids have remainder null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "n_links")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs.withColumn("held_out", F.coalesce(remainder(5) == 1, F.lit(False))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return treap.search(treap.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


OP11_SQL = """
with d as (
  select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as k from documents where text is not null),
t as (
  select k, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
n as (select k, any_value(doc_id) as doc_id, count(*) as n from t group by k),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
tf as (select k, term, count(*)::bigint as tf from t group by all),
df as (select term, count(*)::bigint as df from tf group by term),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark where item_id is not null),
s as (
  select item_id, n.k, any_value(n.doc_id) as doc_id,
    sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from asked join df using (term) join tf using (term) join n using (k), total
  where n.doc_id is not null group by item_id, n.k),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the compression bands."""
    return compression.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), "rules").select("doc_id", "rules.*")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that begin like others."""
    return trie.trie(*trie.with_shared_heads(trie.ordered(table(spark, sf_dir, "conversations"))))


# The crc32 of the decimal number c, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""

OP13_SQL = f"""
with recursive t as (
  select conv_id::bigint as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
convs as (select c, ({CRC32_SQL}) % 4 as h, c - c % 20 as base, count(*) as own from t group by c),
taken as (select c, h, base, own, least(h, coalesce((select o.own from convs o where o.c = convs.base), 0)) as taken from convs),
rebuilt as (
  select taken.c, pos as depth, role, text from taken join t on t.c = base and pos <= taken
  union all select taken.c, pos - h + taken, role, text from taken join t on t.c = taken.c and pos > h),
lens as (select c, taken + greatest(own - h, 0) as n from taken),
step as (select *, md5(length(role) || ':' || role || text) as own_key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from rebuilt),
prefix as (
  select c, depth, md5(string_agg(own_key, ',') over (partition by c order by depth)) as key, words from step
  union all select c, 0, '', 0 from lens),
node as (select depth, key, min(c) as conv_id, count(*) as n_convs, any_value(words) as words from prefix group by depth, key),
above as (select p.depth, p.key, any_value(q.key) as up from prefix p join prefix q on p.c = q.c and q.depth = p.depth - 1 group by all),
children as (select depth - 1 as depth, up as key, count(*) as n_children from above group by all),
ended as (select depth, key, string_agg(c::varchar, ',' order by c) as ids from prefix join lens using (c) where depth = n group by all),
whole as (
  select node.*, a.up, coalesce(n_children, 0) as n_children, sha256(coalesce(ids, '')) as ends_sha256
  from node left join above a using (depth, key) left join children using (depth, key) left join ended using (depth, key)),
below as (
  select p.depth, p.key, count(*) filter (w.n_children = 0) as n_leaves, sum((w.n_convs - 1) * w.words) as saved_tokens
  from whole w join prefix p on p.c = w.conv_id and p.depth <= w.depth group by all)
select w.conv_id, w.depth::bigint as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, w.ends_sha256
from whole w join below b using (depth, key) left join node u on u.depth = w.depth - 1 and u.key = w.up
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_quality_rules": op12_quality_rules,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op3_exact_topk": OP3_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
