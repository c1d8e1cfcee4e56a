"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import convrepair, ctw, decontam, fmdedup, licenses, packing, probminhash, quality, secrets, suffixdedup, toxicity, urls, vectorcodes
from kpiforge.llm.common import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return put


@query("op1_ctw_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ctw.held_out_split(table(spark, sf_dir, "documents"))
    return ctw.score(docs, docs.filter(~F.col("held_out")))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "estimate")


@query("op9_decontaminate", decontam.sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_pattern_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=True)


@query("op10_probminhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "first")


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op8_license_scan", licenses.sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, learnt).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixdedup.dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_walsh_codes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.audit(table(spark, sf_dir, "conversations"))


@query("op11_fm_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fmdedup.dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
