"""The corpus pipeline: documents through five stages, each written and read again.

Documents that the quality rules reject go first, then those that importance resampling towards the labelled good
ones does not draw; of each group of similar texts one stays; sources are mixed to their target weights, a document
that is served twice being there twice; the mix is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.fair_mix import mixed_documents
from gridloom.llm.harmonic_pack import default_tokenizer, pack
from gridloom.llm.importance_resample import resample
from gridloom.llm.jaccard_join import one_per_component
from gridloom.llm.robust_outliers import quality_rules
from gridloom.storage import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language and source."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the labelled good ones."""
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document of the smallest id; repeated rows of one id and text count as one."""
    return one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document served twice is there twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Window counts, determinants, hashed models and tokenizers have no counterpart in SQL; tests use brute force.
ORACLE_SQL = None
