"""Queries of the training-data operators over the driver tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.llm import gridjoin, minhash, mixing, negatives, ngram_join, packing, quality, repair, resample, secrets, substring, toxicity, warc
from rollcall.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose lower-cased four-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.NgramJoin(_table(spark, sf_dir, "documents")).components()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-word passages that start in one of a smaller id."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents' ids, read back from the compressed shards."""
    shards = repair.write_shards(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return repair.read_shards(shards)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, the base rule and the trained verdict for each document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.QualityModel(docs, _table(spark, sf_dir, "labels")).score(docs)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2,048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text, their likeness, and the class of verified near-duplicates."""
    return minhash.fingerprint_and_link(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and its source's size and target."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for each document, and the number of significant passages."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.ToxicityModel(docs, _table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and confirmed secrets of each document."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages' archives, read back from them."""
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and the draw of documents towards the benchmark's distribution of words."""
    scores = resample.importance_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return scores.select("doc_id", "n_features", "weight", "score", "rank")


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of vectors of one label at a cosine of 0.98 or more."""
    return gridjoin.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the positives of every anchor, a row whose id is divisible by 100."""
    rows = negatives.contract_rows(_table(spark, sf_dir, "embeddings"))
    return negatives.HardNegatives(rows).mine(F.col("id") % 100 == 0)


def _prepared(query: Query) -> Query:
    """The query in a session that is ready for it."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_token_output": op3_token_output,
        "op4_quality": op4_quality,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_mix_sources": op7_mix_sources,
        "op8_toxicity": op8_toxicity,
        "op9_secret_scan": op9_secret_scan,
        "op10_warc": op10_warc,
        "op11_importance": op11_importance,
        "op12_near_vectors": op12_near_vectors,
        "op13_hard_negatives": op13_hard_negatives,
    }
    return {name: _prepared(query) for name, query in named.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": ngram_join.COMPONENTS_SQL,
        "op2_substring_dedup": substring.REPEATS_SQL,
        "op7_mix_sources": mixing.MIX_SQL,
        "op10_warc": warc.RECORDS_SQL,
        "op11_importance": resample.SCORES_SQL,
        "op12_near_vectors": gridjoin.LINKS_SQL,
        "op13_hard_negatives": negatives.NEGATIVES_SQL,
    }
