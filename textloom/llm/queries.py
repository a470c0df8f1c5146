"""The registered queries opN_* and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import decontaminate, lmscore, mixing, pii, quality, sharding, simhash, substrings, tokenfile, tokens
from .common import table


def op1_lm_backoff(spark, sf_dir):
    return lmscore.lm_scores(table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_repeated_windows(spark, sf_dir):
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op6_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii_field(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_mix_entropy(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash_vptree(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_quality_mcd(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_shard_lookup(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_backoff, op2_mix_entropy, op3_token_files, op4_simhash_vptree, op5_repeated_windows,
        op6_token_counts, op7_decontaminate, op8_quality_mcd, op9_shard_lookup, op10_pii_field,
    )
}
ORACLE_SQL = {"op5_repeated_windows": substrings.oracle(), "op7_decontaminate": decontaminate.oracle(), "op9_shard_lookup": sharding.oracle()}
