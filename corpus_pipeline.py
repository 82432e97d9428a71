"""Corpus pipeline over `documents`: five stages, each on all that the one before kept.

1. language: documents without letters go, and those far less like their language than its texts of that length are.
2. lines: lines that many documents repeat stay in one of them.
3. near duplicates: of each group linked by SimHash the smallest doc_id stays.
4. decontamination: documents that hold a benchmark window go.
5. mixing: sources are sampled to target weights; `taken` says how many words the mix takes of a document
   (more than `size` where it is repeated).

Every stage takes any rows with the columns of documents: null texts count as empty (stage 1 drops them,
having no letters), extra columns pass through, an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import common, decontaminate, langid, linededup, mixing, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.benchmark(spark, sf_dir))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.quality_weights(common.labels(spark, sf_dir)))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix)]

#: The first stage learns its prototypes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep_stages: bool = False) -> DataFrame:
    """The stages one after the other; what each keeps is written to the shared folder and read again.

    A stage's rows are removed once the next one's are written, unless keep_stages; the last one's stay. What operators
    checkpoint on the way goes when Spark's cleaner finds it unused, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    place = f"{common.shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4()}"
    docs, before = common.documents(spark, sf_dir), None
    for number, (name, stage) in enumerate(STAGES):
        here = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before and not keep_stages:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        before = here
    return docs
