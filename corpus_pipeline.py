"""A training corpus from raw documents: rules, near-duplicates, privacy, mixture, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's input. All but the last return the columns of ``documents``.
"""

import public_tokenizers

from quadweave.llm import mixture, packing, pseudonyms, rules, simhash
from quadweave.llm.common import written


def quality(spark, docs, sf_dir):
    """Documents that no quality rule rejects."""
    return rules.quality_filter(docs)


def deduplicate(spark, docs, sf_dir):
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def protect(spark, docs, sf_dir):
    """Personal numbers and dates under pseudonyms."""
    return pseudonyms.pseudonymised(docs, count=None)


def mix(spark, docs, sf_dir):
    """Sources in their target shares: a row per document and pass, with the words that the mix takes."""
    return mixture.mix_documents(docs)


def pack(spark, docs, sf_dir):
    """Token pieces with their places in sequences of 4096."""
    return packing.packing_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", deduplicate), ("privacy", protect), ("mixture", mix), ("packing", pack)]

#: Fingerprints, pseudonyms and the tokenizer have no SQL form; tests use a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
