"""Registered queries of the corpus operators, with SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quadweave.llm import (
    alignment, chat, curve, html_text, importance, mixture, neighbors, packing, pseudonyms, rules, simhash, token_file, toxicity,
)
from quadweave.llm.common import work_folder

CHAT_PROBE = "</s>[INST] ok [/INST]"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return rules.quality_report(table(spark, sf_dir, "documents"))


def op2_token_codes(spark, sf_dir):
    path = work_folder(spark, "tokens")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_documents(spark, path)


def op3_page_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op4_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_pseudonyms")


def op5_nearest(spark, sf_dir):
    return neighbors.nearest(table(spark, sf_dir, "embeddings"))


def op6_packing(spark, sf_dir):
    return packing.packing_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", CHAT_PROBE), (-7, 1, "assistant", CHAT_PROBE)], rows.schema)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat.conversation_digest(chat.format_conversations(rows.unionByName(probe), tokenizer), tokenizer)


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixture(spark, sf_dir):
    return mixture.mix_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment_report(table(spark, sf_dir, "documents"), *paths)


def op12_curve_shards(spark, sf_dir):
    path = work_folder(spark, "shards")
    curve.write_shards(table(spark, sf_dir, "documents"), path)
    return curve.shard_report(curve.read_shards(spark, path))


def op13_resampling(spark, sf_dir):
    return importance.resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_codes, op3_page_text, op4_pseudonyms, op5_nearest, op6_packing, op7_chat, op8_toxicity,
        op9_mixture, op10_simhash, op11_alignment, op12_curve_shards, op13_resampling, pipeline,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_quality_rules": rf"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        w as (select doc_id, t, regexp_extract_all(t, '{_WORD}') as ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls from d),
        p as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w),
        g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from p),
        r as (select doc_id, count(distinct i + k) as n_repeat_words from g, (values (0), (1), (2)) as v(k) where n > 1 group by doc_id),
        s as (select w.doc_id, ws, ls, t, len(ws)::bigint as n_words,
                     coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
                     (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
                     coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words
              from w left join r on w.doc_id = r.doc_id)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {int(100 * rules.MAX_REPEATED)} * n_words as base_failed,
               not (n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {int(100 * rules.MAX_REPEATED)} * n_words)
               and n_symbols <= {rules.MAX_SYMBOLS_PER_WORD} * n_words
               and word_chars between {rules.MEAN_WORD_CHARS[0]} * n_words and {rules.MEAN_WORD_CHARS[1]} * n_words
               and n_dup_lines <= {rules.MAX_REPEATED_LINES} * len(ls)
               and length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= {rules.MIN_LETTERS} * word_chars
               and len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) <= {rules.MAX_ELLIPSIS_LINES} * len(ls) as kept
        from s""",
    "op5_nearest": """
        with v as (select vec_id, embedding::double[] as e from embeddings),
        c as (select q.vec_id as query_id, v.vec_id,
                     list_reduce(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]), lambda a, b: a + b)
                     / (sqrt(list_reduce(list_transform(q.e, lambda x: x * x), lambda a, b: a + b)) * sqrt(list_reduce(list_transform(v.e, lambda x: x * x), lambda a, b: a + b))) as score
              from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
        r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from c)
        select query_id, rank, vec_id, score from r where rank <= 5""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
