"""The queries opN_<name>: thin layers over the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from kadastra.llm import alignment, exact_dedup, jaccard, line_dedup, mixing, neighbours, repair, sampling, simhash, substring_dedup, token_counts, token_files, toxicity
from kadastra.llm.common import new_path, table


def op1_token_files(spark, sf_dir):
    path = new_path(spark, "token-ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.describe_ids(spark, path)


def op2_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_sample_encodings(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    drawn = sampling.sample_encodings(table(spark, sf_dir, "documents"), model, decoded=True)
    return drawn.select(
        "doc_id",
        "draw",
        F.size("ids").cast("long").alias("n_tokens"),
        "log_prob",
        "perturbed",
        "log_inclusion",
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_mix_sources(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_nearest(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_jaccard_join(spark, sf_dir):
    return jaccard.linked_groups(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark, sf_dir):
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sample_encodings": op3_sample_encodings,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest": op7_nearest,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_mix_sources": mixing.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
}
