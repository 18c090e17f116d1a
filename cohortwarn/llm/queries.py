"""Registered queries of the operators: each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwarn.llm import bpe_automaton, collocations, conversation_repair, disclosure, exact_dedup, langid, mixing, order_minhash, packing, records, simhash, substring_dedup, toxicity
from cohortwarn.llm.common import documents, held_out
from cohortwarn.session import new_folder

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir)).drop("file", "row")


SQL["op1_exact_dedup"] = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from d"""


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe_automaton.encode(docs, WORD_TOKENIZER, ids=False).drop("text")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "records")
    records.write_records(documents(spark, sf_dir), folder, BYTE_TOKENIZER)
    return records.read_records(spark, folder, ids=False)


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_edited(documents(spark, sf_dir))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(documents(spark, sf_dir))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"n_{k}" for k in disclosure.KINDS]
    return disclosure.find(documents(spark, sf_dir)).select("doc_id", *counts, "base_sha256", "spans")


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(documents(spark, sf_dir, "conversations"))


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_TOKENIZER)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


SQL["op13_collocations"] = r"""
with pieces as (
  select lang, unnest(p) as piece from (
    select coalesce(lang, 'und') as lang, string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p
    from documents)),
numbered as (
  select row_number() over () as piece_no, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w
  from pieces),
words as (select piece_no, lang, unnest(w) as w1, generate_subscripts(w, 1) as i from numbered),
ahead as (
  select *, lead(w1) over o as w2, lead(w1, 2) over o as w3, lead(w1, 3) over o as w4
  from words window o as (partition by piece_no order by i)),
grams as (
  select lang, 1 as k, w1 as phrase from ahead
  union all select lang, 2, w1 || ' ' || w2 from ahead where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from ahead where w3 is not null
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from ahead where w4 is not null),
f as (select lang, k, phrase, count(*) as n from grams group by all),
totals as (select lang, sum(n) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 30),
cut as (
  select c.lang, c.phrase, c.a, j.j, l.n as l, r.n as r,
    (2000000::hugeint * c.a) // (l.n + r.n) as score
  from c join (values (1), (2), (3)) as j(j) on j.j < c.k
  join f l on l.lang = c.lang and l.k = j.j and l.phrase = array_to_string(c.w[1:j.j], ' ')
  join f r on r.lang = c.lang and r.k = c.k - j.j and r.phrase = array_to_string(c.w[j.j+1:c.k], ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (
  select c.lang, array_to_string(c.w[s.s:s.s+m.m-1], ' ') as phrase, max(c.a) as longer
  from c join (values (2), (3)) as m(m) on m.m < c.k join (values (1), (2), (3)) as s(s) on s.s + m.m - 1 <= c.k
  group by all),
kept as (
  select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase
  where i.longer is null or 100::hugeint * i.longer < 80::hugeint * b.a)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)) as rank, phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, t.n::bigint as n, score::bigint as score
from kept k join totals t on t.lang = k.lang
qualify rank <= 2000"""
