"""The corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``. ``run`` applies them in order and writes each
stage's rows once, as Parquet in the checkpoint folder that executors share, so
that no stage is computed twice. A stage's rows are removed when the next one's
are written.

Cases: null texts stay until a stage's rule takes them (they have no language).
Without labelled rows the quality stage keeps all. A null doc_id is its own group
in the near-duplicate stage and loses no text; repeated rows are treated alike.
Empty tables pass through. Extra columns, of any name, stay until the last stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from pelagia.llm import langid, near_dup, packing, quality, suffix_dedup
from pelagia.llm.bpe import public_path
from pelagia.session import prepare

WORD_BPE = "word_bpe_49k.json"


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at or above its threshold stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language stay."""
    return langid.keep_known(docs, public_path(langid.MODEL))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays."""
    return near_dup.deduplicate(docs)


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that a document with a smaller doc_id has too are cut out of the texts."""
    return suffix_dedup.remove_repeats(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all kept documents; one row per piece."""
    return packing.pack_documents(docs, public_path(WORD_BPE))


STAGES = [
    ("quality classifier", stage_quality),
    ("language ID", stage_language),
    ("MinHash near-dedup", stage_near_dedup),
    ("suffix-array dedup", stage_repeats),
    ("best-fit packing", stage_packing),
]
#: SQL can't express the learned stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
