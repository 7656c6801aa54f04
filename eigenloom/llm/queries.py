"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .frames import table
from .hard_negatives import mine
from .idcoder import read_ids, write_ids
from .kmeans_tree import near_neighbours
from .language import fit_language
from .oracle import ORACLE  # noqa: F401
from .packing import pack_documents
from .pieces import round_trip
from .pii import KINDS, digest, find_pii
from .quality import importance_sample
from .simhash import near_duplicates
from .substring_dedup import repeat_digest
from .toxicity import fit_toxicity
from .voronoi import exact_top_k
from .whitening import whiten


def fold(col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def op1_sentencepiece(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_substring_dedup(spark, sf_dir):
    return repeat_digest(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), use=fold("k", 3) != 1)
    held_out = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    return model.score(held_out).drop("text")


def op5_token_ids(spark, sf_dir):
    path = scratch_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, added=True)
    return read_ids(spark, path, ids=False)


def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added=True)


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs, use=fold("k", 4) != 2)
    return model.predict(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))).drop("text")


def op9_nearest_neighbours(spark, sf_dir):
    return near_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_quality(spark, sf_dir):
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_personal_data(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op12_hard_negatives(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(df, F.col("id") % 100 == 0)


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op6_simhash, op7_best_fit_packing, op3_exact_top_k, op4_toxicity, op5_token_ids, op8_language, op9_nearest_neighbours, op10_quality, op11_personal_data, op12_hard_negatives, op13_whitening)}
