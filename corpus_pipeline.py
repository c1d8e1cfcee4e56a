"""Corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet into the shared folder and reads it again as the next
stage's docs. All stages but the last return the columns of documents.

1. quality rules: documents that the base rules or the MCD outlier test
   reject go;
2. near duplicates: one document of each class stays (least doc_id);
3. benchmark decontamination: contaminated documents go;
4. secret scan: secrets are replaced in the text, all documents stay;
5. packing: the rows are the packed token pieces, with their token ids.

Rows that repeat an id are judged each by their own text; of rows equal
in id and text stage 2 keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiforge.llm import decontam, packing, probminhash, quality, secrets
from kpiforge.llm.common import table, tokenizer_path, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.scan(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express token ids, MCD or ProbMinHash; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
