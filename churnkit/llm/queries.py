"""The registered queries of this package: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.llm import common as C
from churnkit.llm import (decontaminate, language, lexical, line_dedup, packing, phrases, quality, simhash,
                          substring_dedup, token_counts, token_files, toxicity, warc)

TOKENIZER = "byte_bpe_50k.json"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(C.table(spark, sf_dir, "documents"), shingle=3, distance=2, seed=42)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=1024)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_substrings(C.table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(C.table(spark, sf_dir, "pages"), C.fresh_path(spark, "warc"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(C.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                                  capacity=1024, end_id=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    models = language.learn(docs.where(~C.held_out()))
    return language.identify(docs, models).select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, docs.where(~C.held_out()), C.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", C.held_out().alias("held_out"), "score", "predicted")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(C.table(spark, sf_dir, "documents"), least=100, depth=5, share=100, top=2000)


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), top=50)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(C.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                                  C.fresh_path(spark, "ids"), end_id=0)


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_token_counts, op3_substring_dedup, op4_quality_rules, op5_warc, op6_line_dedup,
    op7_best_fit_packing, op8_language_id, op9_benchmark_decontamination, op10_toxicity, op11_phrase_collocations,
    op12_ranked_lexical_search, op13_token_files)}

ORACLES = {
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, octet_length(encode(html)) as n, sha1(html) as hex,
             max(page_id) over (partition by html) as keeper from p),
b as (select *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::bigint) as parts from d)
select page_id, cast(n as bigint) as payload_bytes,
       list_aggregate(list_transform(range(32), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31)::integer + 1, 1)),
         'string_agg', '') as payload_digest,
       case when page_id < keeper then 'revisit' else 'response' end as record_type,
       case when page_id < keeper then keeper end as refers_to
from b""",
    "op6_line_dedup": """
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line,
                  generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
w as (select doc_id, text, pos, line,
             lead(line) over d as second, lead(line, 2) over d as third, lead(pos, 2) over d as last
      from l window d as (partition by doc_id, text order by pos)),
r as (select doc_id, text, pos,
             row_number() over (partition by line, second, third order by doc_id, pos) as nth
      from w where last is not null),
gone as (select distinct doc_id, text, pos + k as pos
         from r, (select unnest([0, 1, 2]) as k) where nth > 1),
kept as (select l.doc_id, l.text, count(*) as n_lines, count(g.pos) as n_removed,
                coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as kept
         from l left join gone g on l.doc_id = g.doc_id and l.text = g.text and l.pos = g.pos
         group by l.doc_id, l.text)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_removed as bigint) as n_removed,
       sha256(kept) as kept_sha256 from kept
union all
select doc_id, 0, 0, null from documents where text is null""",
    "op11_phrase_collocations": r"""
with pieces as (select lang, row_number() over () as piece, piece as t from (
       select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
words as (select lang, regexp_extract_all(t, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
grams as (select lang, len(g) as m, array_to_string(g, ' ') as phrase, count(*) as f
          from (select lang, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i:
                  list_transform(range(1, least(5, len(w) - i + 1) + 1), lambda m: w[i:i + m - 1])))) as g from words)
          group by all having count(*) >= 100),
cuts as (select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, n,
                (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
         from (select *, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from grams where m > 1) c
         join grams l on l.lang = c.lang and l.phrase = array_to_string(w[1:k], ' ')
         join grams r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1:], ' ')
         join totals t on t.lang = c.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (select distinct x.lang, x.phrase from (
              select lang, f, unnest(flatten(list_transform(range(2, m), lambda s:
                list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) as phrase
              from (select *, string_split(phrase, ' ') as w from grams where m > 2)) longer
            join grams x on x.lang = longer.lang and x.phrase = longer.phrase and longer.f * 100 >= x.f * 100)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase,
       a, l, r, n, cast(score as bigint) as score
from best anti join covered using (lang, phrase)
qualify row_number() over (partition by lang order by score desc, a desc, encode(phrase)) <= 2000""",
    "op12_ranked_lexical_search": r"""
with asked as (select distinct item_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
words as (select doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from words group by all),
lens as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
corpus as (select count(*) as n_docs, cast(sum(n) as bigint) as total from lens),
weight as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w
           from tf, corpus group by term),
norm as (select doc_id, 50 + (50 * n * n_docs) // total as m from lens, corpus),
scored as (select item_id, doc_id,
                  cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
           from asked join tf using (term) join weight using (term) join norm using (doc_id) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0)
select item_id, cast(r as integer) as rank, doc_id, score from ranked where r <= 50""",
}
