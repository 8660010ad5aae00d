"""From raw documents to piece ids in five stages, each one of the operators of ``brindle.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again, so no stage recomputes another and lost executors cost one stage at most; a stage's
folder is deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language, mixing, near_dedup, quality, sentencepiece
from brindle.session import remove_path, shared_path, table


#: Rows of an Arrow batch where the session has Spark's own default: whole texts are long, and such batches are held by JVM and worker.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's limit for Arrow batches unless somebody has chosen another than the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or with half of their letters in no one learned language, go."""
    _small_batches(spark)
    return language.keep_known(docs, language.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that fail the base rules or lose half of their text."""
    _small_batches(spark)
    return quality.clean_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    _small_batches(spark)
    return near_dedup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a row per document and pass."""
    return mixing.mixed_documents(docs, block_words=512)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    coded = sentencepiece.encode(docs, decoded_col="decoded")
    same = F.col("decoded") == F.translate("text", "▁", " ")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("source_mix", source_mix),
    ("sentencepiece", piece_ids),
]

#: Neither language models nor the checks on signatures and pieces can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
