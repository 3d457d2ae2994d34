"""The registered queries over the operators of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.brown import score

    return score(_table(spark, sf_dir, "documents"))


def op2_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.bitpack import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.decontaminate import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.chat import canonical, digest, template

    hard = "</s>[INST] ok [/INST]"
    planted = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(*(F.struct(F.lit(r).alias("role"), F.lit(hard).alias("content")) for r in ("user", "assistant"))).alias("messages"))
    return digest(template(canonical(_table(spark, sf_dir, "conversations")).unionByName(canonical(planted))))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.ann import search

    own = _table(spark, sf_dir, "embeddings")
    return search(own, own.where("vec_id % 50 = 0"), k=5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Words in hosts by which the weak source tells junk: pharmacy, gambling, adult, advertising and spam sites.
TERMS = "adult ads bet bets betting casino escort gambling pharmacy pills poker porn slots spam tracker viagra xxx".split()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.urlfilter import fit, judge, weak_labels

    pages = _table(spark, sf_dir, "pages")
    return judge(pages, RULES, fit(weak_labels(pages, TERMS)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.langid import fit, held_out, identify

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs)))
    flags = docs.select("doc_id", "text", held_out(docs).alias("held_out"))
    return identify(flags, model, keep=["held_out"])


def queries() -> dict:
    own = [n for n in globals() if n.startswith("op") and n[2].isdigit()]
    return {n: globals()[n] for n in sorted(own, key=lambda n: int(n[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_STUFFED = r"regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')"

#: The other operators use tokenizers, XXH64 or models, which SQL doesn't have; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {
    "op4_decontaminate": f"""
with d as (select doc_id, row_number() over () as rid, {_WORDS} as w from documents),
i as (select item_id, row_number() over () as iid, {_WORDS} as w from benchmark),
iw as (select distinct iid, item_id, m, array_to_string(w[p:p + m - 1], ' ') as k
       from (select iid, item_id, w, least(len(w), 10) as m, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0) t),
dw as (select rid, p, m, array_to_string(w[p:p + m - 1], ' ') as k
       from (select rid, w, m, unnest(range(1, len(w) - m + 2)) as p from d, (select distinct m from iw) s where len(w) >= m) t),
hits as (select rid, p, dw.m, iid, item_id from dw join iw on dw.m = iw.m and dw.k = iw.k),
pos as (select rid, count(distinct x) as n from (select rid, unnest(range(p, p + m)) as x from (select distinct rid, p, m from hits) t) t group by rid),
its as (select rid, count(*) as n, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from (select distinct rid, iid, item_id from hits) t group by rid)
select doc_id, len(w) as n_words, coalesce(pos.n, 0) as n_hit, coalesce(its.n, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(pos.n, 0) > 0 as contaminated
from d left join pos on d.rid = pos.rid left join its on d.rid = its.rid""",
    "op5_chat_format": f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, case when role = 'assistant' then length({_STUFFED}) + 4 else 14 + length(url_encode(role)) + length({_STUFFED}) end as n from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(3 + sum(n) as bigint) as formatted_chars
from f group by conv_id""",
}
