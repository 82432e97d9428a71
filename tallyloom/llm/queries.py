"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, langid, linededup, merkle, mixing, negatives, oracles, packing, periodic, pii, simhash, substring_bwt, substring_sam, toxicity
from .common import benchmark, documents, labels


def op1_decontamination(spark, sf_dir):
    return decontaminate.hit_report(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op2_substring_bwt(spark, sf_dir):
    return substring_bwt.removal_report(documents(spark, sf_dir))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_substring_automaton(spark, sf_dir):
    return substring_sam.removal_report(documents(spark, sf_dir))


def op5_pii(spark, sf_dir):
    return pii.pii_report(documents(spark, sf_dir))


def op6_language(spark, sf_dir):
    return langid.language_report(documents(spark, sf_dir))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_merkle(spark, sf_dir):
    """Writes 8 digits of the hashes below the root."""
    return merkle.fingerprint_report(documents(spark, sf_dir), digits=8)


def op8_merkle_whole(spark, sf_dir):
    return merkle.fingerprint_report(documents(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir), mixing.quality_weights(labels(spark, sf_dir)))


def op10_line_dedup(spark, sf_dir):
    return linededup.line_report(documents(spark, sf_dir))


def op11_periodic_runs(spark, sf_dir):
    """A tenth of the documents get a run planted before."""
    return periodic.run_report(periodic.planted(documents(spark, sf_dir)))


def op12_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack_report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark, sf_dir):
    """Anchors are the ids divisible by 50; of the ids divisible by 7 the label is moved on."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_substring_bwt,
        op3_toxicity,
        op4_substring_automaton,
        op5_pii,
        op6_language,
        op7_simhash,
        op8_merkle,
        op9_mixing,
        op10_line_dedup,
        op11_periodic_runs,
        op12_packing,
        op13_hard_negatives,
    )
}

#: The fingerprints again, with all digits.
WHOLE = {"op8_merkle_whole": op8_merkle_whole}

ORACLE_SQL = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op2_substring_bwt": oracles.SUBSTRING_BYTES,
    "op4_substring_automaton": oracles.SUBSTRING_WORDS,
    "op5_pii": oracles.PII,
    "op8_merkle": oracles.merkle(8),
    "op8_merkle_whole": oracles.merkle(32),
    "op9_mixing": oracles.MIXING,
    "op10_line_dedup": oracles.LINE_DEDUP,
    "op11_periodic_runs": oracles.PERIODIC,
    "op13_hard_negatives": oracles.NEGATIVES,
}
