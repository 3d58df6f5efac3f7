"""The queries opN_<name> and pipeline, and the SQL of those that SQL can express.

Each query is thin: it applies its operator to the whole intended table and
derives the columns that its contract asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_repeats, decontaminate, exact_dedup, language_id, ngram_join, packing, preference_format, shard_store, url_filter, word_repeats
from .frames import fresh_path, table, tagged

TOKENIZER_FILE = "word_bpe_49k.json"
RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out()
    model = language_id.fit(docs.where(~held_out), order=F.col("doc_id"))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op2_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats.byte_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("row_tag", "class_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes (of its text), shard_id, shard_bytes, version: where each document is after compaction."""
    store = shard_store.sharded(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    found = store.manifest()
    shards = spark.createDataFrame([(s.path, i, s.bytes) for i, s in enumerate(found["shards"])], f"{shard_store.SHARD} string, shard_id int, shard_bytes long")
    rows = store.read().select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), shard_store.SHARD)
    return rows.join(shards, shard_store.SHARD).select("doc_id", "n_bytes", "shard_id", "shard_bytes", F.lit(found["version"]).alias("version"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("row_tag")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = tagged(docs.select("text")).select("row_tag", exact_dedup.digest(F.col("text")).alias("text_sha256"))
    return exact_dedup.exact_dedup(docs).join(digests, "row_tag").drop("row_tag")


OP6_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""


def op7_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_repeats.word_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
with p as (select page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path from pages),
rules(verdict, h, pre) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best as (select page_id, arg_max(h || pre, length(h || pre)) as rule, arg_max(verdict, length(h || pre)) as verdict
    from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (page_id)
"""


def spans(c: str):
    return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")


def stale_reply(conversations: DataFrame) -> DataFrame:
    """A rejected side for each conversation: its last assistant turn says what its first one said, and nothing if they are the same turn."""
    said = F.col("role") == "assistant"
    ends = conversations.where(said).groupBy("conv_id").agg(F.max("turn").alias("_last"), F.min(F.struct("turn", "text")).alias("_first"))
    stale = F.when(F.col("_last") == F.col("_first.turn"), F.lit("")).otherwise(F.col("_first.text"))
    return conversations.join(ends, "conv_id", "left").withColumn("text", F.when(said & (F.col("turn") == F.col("_last")), stale).otherwise(F.col("text"))).select("conv_id", "turn", "role", "text")


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = preference_format.preference_format(chosen, stale_reply(chosen))
    return out.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


OP10_SQL = """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
e as (select conv_id, max(turn) as last, min(turn) as first, arg_min(text, turn) as said from c where role = 'assistant' group by conv_id),
b as (select c.conv_id, c.turn, c.role, c.text,
    case when c.role = 'assistant' and c.turn = e.last then case when e.last = e.first then '' else e.said end else c.text end as other
    from c left join e using (conv_id)),
d as (select *, min(case when text <> other then turn end) over (partition by conv_id) as off from b),
r as (select *, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) as head,
    replace(text, '<|', '< |') || '<|end|>' || chr(10) as t1, replace(other, '<|', '< |') || '<|end|>' || chr(10) as t2,
    off is null or turn < off as common from d),
s as (select *, cast(coalesce(sum(case when not common then length(head) + length(t1) end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as at1,
    cast(coalesce(sum(case when not common then length(head) + length(t2) end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as at2 from r)
select conv_id, cast(count(*) filter (where common) as bigint) as n_common,
    coalesce(string_agg(head || t1, '' order by turn) filter (where common), '') as prompt,
    coalesce(string_agg(head || t1, '' order by turn) filter (where not common), '') as chosen,
    coalesce(string_agg(head || t2, '' order by turn) filter (where not common), '') as rejected,
    coalesce(string_agg((at1 + length(head)) || '-' || (at1 + length(head) + length(t1) - 1), ',' order by turn) filter (where not common and role = 'assistant'), '') as chosen_mask,
    coalesce(string_agg((at2 + length(head)) || '-' || (at2 + length(head) + length(t2) - 1), ',' order by turn) filter (where not common and role = 'assistant'), '') as rejected_mask,
    bool_or(not common) as informative
from s group by conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_preference_format": OP10_SQL}
