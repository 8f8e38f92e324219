"""The corpus pipeline: language ID, near-dedup, secret masking, mixing and tokenisation of `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.bpe import encode_documents
from tallyspark.llm.common import shared_folder, table
from tallyspark.llm.langid import known_languages
from tallyspark.llm.mixing import emitted
from tallyspark.llm.secrets import mask_secrets
from tallyspark.llm.simhash import one_of_each

#: Bytes of a batch between Spark and Python: workers of five operators share an executor's memory.
ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = "8m"
#: For the same reason the tokenizer remembers so much of what it does alone.
TOKENIZER_KEPT = 0.5


def _stage(operator):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ARROW_CONF, ARROW_BYTES)  # run() puts it back; a stage of its own leaves it, as its plan is lazy
        return operator(docs)

    return stage


#: Every stage takes (spark, docs, sf_dir). All but the last return the columns of `documents`; the last the tokenised
#: corpus, with the ids of every document.
STAGES = [
    ("language_id", _stage(known_languages)),
    ("near_dedup", _stage(one_of_each)),
    ("secret_scan", _stage(mask_secrets)),
    ("source_mixing", _stage(emitted)),
    ("byte_bpe", _stage(lambda docs: encode_documents(docs, kept=TOKENIZER_KEPT))),
]

#: Fingerprints, trigram models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a stage's table by way of the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the tokenised corpus. What a stage returns is written to the shared folder and read again
    by the next one; once that has written its own, it is deleted.

    The corpus itself, with its ids, stays in the folder `4_byte_bpe` of the run.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    was = spark.conf.get(ARROW_CONF, None)
    try:
        for k, (name, stage) in enumerate(STAGES):
            own = f"{folder}/{k}_{name}"
            stage(spark, docs, sf_dir).write.parquet(own)
            docs = spark.read.parquet(own)
            if before:
                _remove(spark, before)
            before = own
    finally:
        if was is None:
            spark.conf.unset(ARROW_CONF)
        else:
            spark.conf.set(ARROW_CONF, was)
    return docs.drop("ids")
