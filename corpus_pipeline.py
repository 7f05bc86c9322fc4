"""Training-data pipeline over ``documents``: five stages, each on what the one before it kept.

The classifier drops low quality, the n-gram Jaccard join leaves one document of each group of near
copies (five words, 0.8), decontamination drops documents that hold a benchmark passage, personal
data is replaced by its kind, and the rest is packed into sequences. A stage gets the documents
that its predecessor kept and returns them with all their columns; the last returns pieces.

Nulls, ties and repeats: null and empty texts have no words, so only the classifier can drop them, and the
last stage packs their closing id; rows with a null id are judged as others are, and are no one's
copies; of rows that share an id one stays after the near copies; rows that repeat are judged alike;
an empty table stays empty; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapdiff.llm import decontaminate, jaccard_join, packing, pii, quality
from snapdiff.llm.storage import stored

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written as Parquet to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
