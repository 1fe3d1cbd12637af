"""A corpus from raw documents to packed sequences: toxic and near-duplicate documents go, personal data is masked,
sources are mixed to weights and what remains is packed. Each stage's result is written and read back by the next.

All stages but the last return the columns of their input, whatever else those are called. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._tables import free_names, saved
from barloom.llm.mixing import mixed_documents
from barloom.llm.ngram_join import few, near_duplicates
from barloom.llm.packing import pack_documents, tokenizer_path
from barloom.llm.pii import redact
from barloom.llm.toxicity import score_toxicity, train

#: Documents with at least this score go; the operator's own verdict.
TOXIC = 0.3

#: The packing rule and the fitted classifier can't be written in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the classifier learns from the table of labels.

    Null and empty texts have the score of a text without known words. Repeated rows have one score and stay or go together.
    """
    (score,) = free_names(docs, "score")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, out=score).where(F.col(score) < TOXIC).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id as text, then text digest.

    Texts without words (null and empty too) are linked with nothing and stay. Of rows equal in id and text one stays.
    """
    key, other, again = free_names(docs, "key", "other", "again")
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    named = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest))
    found = saved(near_duplicates(named, key=key), "components")
    others = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(other))
    repeated = found.groupBy(key).count().where("count > 1").select(F.col(key).alias(again))
    first = named.join(few(others), F.col(key) == F.col(other), "left_anti")
    repeated = few(repeated)
    single = first.join(repeated, F.col(key) == F.col(again), "left_anti")
    one = first.join(repeated, F.col(key) == F.col(again), "left_semi").dropDuplicates([key])
    return single.unionByName(one).drop(key)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind. Null and empty texts and repeated rows stay as they are."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source, and one without any word is kept once. Of rows equal in id and text as many are taken as the budget allows."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places; a null or empty text is its end token. See barloom.llm.packing."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
