"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import (
    chat_format,
    decontamination,
    html_text,
    language_id,
    mtree,
    sentencepiece_viterbi,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from lexweave.llm._common import dealt, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(dealt(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 512)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(dealt(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(dealt(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = dealt(spark, sf_dir, "documents")
    return language_id.identify(documents, language_id.train(documents))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))))))
    both = rows.unionByName(more).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    return chat_format.digest(chat_format.format_chats(both))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = dealt(spark, sf_dir, "documents")
    return toxicity.grade(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.digest(dealt(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(dealt(spark, sf_dir, "pages"))


def op10_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.quantised(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts,
            op2_simhash,
            op3_decontamination,
            op4_rendezvous_sharding,
            op5_language_id,
            op6_chat_format,
            op7_toxicity,
            op8_sentencepiece,
            op9_html_text,
            op10_mtree_topk,
        )
    }


_CONTROLS = [("&", "&amp;"), ("<|", "&lt;|"), ("</s>", "&lt;/s>"), ("<s>", "&lt;s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]")]


def _escaped(column: str) -> str:
    for plain, written in _CONTROLS:
        column = f"replace({column}, '{plain}', '{written}')"
    return column


#: CRC-32 of a text's bytes: the table of the reversed polynomial, then one step for each byte.
_CRC_TABLE = "(select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)))"
_NIBBLES = "list_transform(string_split(lower(hex(encode(coalesce(text, '')))), ''), lambda x: strpos('0123456789abcdef', x) - 1)"
_BYTES = "list_transform(list_zip(n[1:-:2], n[2:-:2]), lambda x: 16 * x[1] + x[2])"


def _shard_sql(shards: int) -> str:
    """Of equal weights, the least ``-ln(u)`` is the greatest u."""
    return f"arg_max(s, left(md5(coalesce(doc_id::varchar, '') || ':' || s), 13)) filter (where s < {shards})"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express: 4, 6 and 10. The others are tested by brute force."""
    return {
        "op4_rendezvous_sharding": f"""
            with b as (select doc_id, coalesce(octet_length(encode(text)), 0) + 1 size, {_NIBBLES} n from documents),
            t as (select {_CRC_TABLE} crc),
            c as (select doc_id, size, case when size = 1 then 0 else xor(4294967295, list_reduce(list_concat([4294967295], {_BYTES}),
              lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) end text_crc32 from b, t),
            r as (select doc_id, {_shard_sql(8)}::int shard, {_shard_sql(9)}::int grown_shard from documents, range(9) g(s) group by 1)
            select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'key' as law, shard,
              row_number() over (partition by shard order by md5(doc_id::varchar), doc_id, text_crc32, size) - 1 as slot, grown_shard
            from c join r using (doc_id)""",
        "op6_chat_format": f"""
            with t as (
              select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') r, coalesce(text, '') x from conversations
              union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
            select conv_id, count(*)::bigint n_turns,
              sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
              coalesce(sum(length(x)) filter (where r = 'assistant'), 0)::bigint loss_chars,
              sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (where r = 'assistant'), '')) loss_sha256,
              sum(24 + length({_escaped('r')}) + length({_escaped('x')}))::bigint formatted_chars
            from t group by conv_id""",
        "op10_mtree_topk": """
            with v as (
              select vec_id::bigint id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
              where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            s as (select q.id query_id, c.id vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint score
              from v q join v c on q.id <> c.id where q.id % 50 = 0),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
            select query_id, rank, vec_id, score from r where rank <= 5""",
    }
