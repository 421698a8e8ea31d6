"""A corpus pipeline of operators from ``fieldloom.llm``: each stage is written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns
the columns of ``docs``; the last returns packed pieces.  Documents are told apart by their
``doc_id`` and text, so repeated ids do no harm.  Every stage gives an empty result for an empty
table.  Of repeated rows, near_dedup keeps one; the other stages treat each like any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import toxicity
from fieldloom.llm.decontaminate import contaminated
from fieldloom.llm.packing import pack_documents
from fieldloom.llm.pii import mask
from fieldloom.llm.simhash import near_duplicates
from fieldloom.session import shared_dir

#: Words that a benchmark item must have for its presence to be evidence against a document.
PASSAGE_WORDS = 8


def _named(wanted: str, columns: list[str]) -> str:
    """A column name like ``wanted`` that is not taken."""
    while wanted in columns:
        wanted += "_"
    return wanted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose toxicity score is 0.5 or more; NULL and empty texts are scored too."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _named("toxicity", docs.columns)
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest doc_id.

    Of rows that repeat that document's id and text, one stays.  A group without any id keeps the
    document whose text hashes lowest.
    """
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("group_fp").agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    id_, key = _named("_id", docs.columns), _named("_key", docs.columns)
    keep = keep.select(F.col("k.doc_id").alias(id_), F.col("k.text_key").alias(key))
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64("text"))
    same = rows[id_].eqNullSafe(keep[id_]) & (rows[key] == keep[key])
    return rows.join(keep, same, "left_semi").dropDuplicates([id_, key]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item.

    Items of fewer than ``PASSAGE_WORDS`` words are phrases that clean documents hold too; they drop nothing.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), fewest_words=PASSAGE_WORDS)
    id_, key = _named("_id", docs.columns), _named("_key", docs.columns)
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    return docs.join(found, same, "left_anti")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; ``n_chars`` follows, all documents stay."""
    masked = mask(docs)
    if "n_chars" in docs.columns:
        size = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", size)
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens: one row per piece."""
    return pack_documents(docs)


STAGES = [
    ("drop_toxic", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_pii", mask_pii),
    ("pack", pack),
]

#: None: DuckDB has neither XXH64 nor the trained network; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each one's rows to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
