"""A corpus pipeline of five stages, each an operator of millrace.llm: documents that fail the
quality rules go, one document of each group of near copies stays, repeated passages are cut, the
sources are mixed to their target weights, and the mix is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, mixing, packing, quality, substring
from millrace.llm.common import table, writer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.Rules(above=1.645))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(docs, window=25)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("best-fit packing", packed_sequences),
]

#: The mix draws by a hash and the packing needs a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, put = table(spark, sf_dir, "documents"), writer(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else put(docs), sf_dir)
    return docs
