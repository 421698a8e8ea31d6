"""The operators applied to the shared tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .langid import identify
from .middles import SQL as MIDDLES_SQL
from .middles import fill_in_middle
from .packing import pack_documents
from .pii import detect, summarize
from .pii_sql import SQL as PII_SQL
from .quality import SQL as QUALITY_SQL
from .quality import judge
from .registry import ORACLES, QUERIES, query, table
from .sharding import assign_shards
from .simhash import near_duplicates
from .substrings import SQL as SUBSTRINGS_SQL
from .substrings import remove_repeats
from .tokencounts import count_tokens
from .tokenfiles import token_files
from .toxicity import classify
from .vectorcodes import SQL as VECTORS_SQL
from .vectorcodes import compress

__all__ = ["ORACLES", "QUERIES"]


@query("op1_simhash")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op10_pii", PII_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return summarize(detect(table(spark, sf, "documents")))


@query("op2_langid")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return identify(table(spark, sf, "documents"))


@query("op6_quality", QUALITY_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_decontaminate")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_key")


@query("op4_substrings", SUBSTRINGS_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_tokencounts")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"))


#: Production parameter: a shard per group of writers.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


@query("op9_sharding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return assign_shards(table(spark, sf, "documents").select("doc_id"), SHARDS)


@query("op11_middles", MIDDLES_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return fill_in_middle(table(spark, sf, "documents"))


@query("op12_vectorcodes", VECTORS_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return compress(table(spark, sf, "embeddings"))


@query("op13_tokenfiles")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return token_files(table(spark, sf, "documents"))
