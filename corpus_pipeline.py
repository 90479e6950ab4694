"""Training-data pipeline: language ID, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of ``documents``, the last one packed sequences. ``run`` writes each stage's result as Parquet
to the shared checkpoint folder and reads it again for the next.

Defined cases, of every stage: an empty table gives an empty one; extra columns stay as they are,
whatever their names; rows with a null doc_id are documents like all others. A null text counts as
empty. The first stage drops texts without a letter, null and empty ones too, for which no language
can be told. Repeated rows get equal decisions in the first two stages, are copies in the third, and
where they reach the fourth one of them stays if the text has a word. Of equal texts the largest
doc_id stays, of near copies the smallest; between rows with equal ids any one. Very long texts are
read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import exact_dedup, jaccard_join, language, packing, quality
from weir.llm.common import shared_folder, table, whole_row
from weir.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; all stay where no document has a language to learn from."""
    model = language.fit(docs)
    if not model.languages:
        return docs
    found = language.predict(F.col("text"), model)
    return docs.select(whole_row(docs), found.alias("found")).filter("not found.rejected").select("r.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the classifier's threshold; all stay where there is no label to learn from."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not trees.learned:
        return docs
    found = quality.score(F.col("text"), trees)
    return docs.select(whole_row(docs), found.alias("found")).filter(F.col("found") >= quality.KEEP).select("r.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word n-grams at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, 5, 80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    path = tokenizer_file("byte_bpe_50k.json")
    return packing.pack(docs, lambda: packing.byte_bpe(path), 2048, 1)


STAGES = [("language_id", language_id), ("quality", quality_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", pack)]

#: The first two stages are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
