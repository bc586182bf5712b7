"""From raw documents to packed training batches: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
caller writes each stage's result and rereads it as the next one's docs; run() does so in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.lines import drop_recurring_lines
from tessella.llm.minhash import drop_near_duplicates
from tessella.llm.mixing import mix_sources
from tessella.llm.packing import pack
from tessella.llm.toxicity import drop_toxic, fit_toxicity
from tessella.storage import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labelled documents among docs.

    Null, empty and blank texts score as an empty average. Labels with a null id or label, and of documents that are not
    in docs, count for nothing; without any, all documents score alike (0.5) and stay. Repeated rows are scored each
    for itself. Further columns pass. An empty table stays empty.
    """
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all places but the first; every document stays, maybe without text.

    Null and empty texts stay as they are. Rows that repeat doc_id and text are one document and keep the same lines.
    Further columns pass, n_chars is set to the new length. An empty table stays empty.
    """
    return drop_recurring_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8.

    Documents are compared by their texts in docs and, where lines were taken out, by the whole texts in the table of
    documents: a copy that line dedup left in pieces is still a copy. A document of which line dedup left nothing goes.
    The whole text counts only if what docs has is a remainder of it.

    Other null, empty and blank texts are like nothing and stay; rows with a null doc_id stay. Rows that repeat a doc_id
    go together. Further columns pass. An empty table stays empty.
    """
    return drop_near_duplicates(docs, whole=spark.read.parquet(f"{sf_dir}/documents.parquet"), width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares of the characters, as many in all as there were.

    A null source is a source of its own; null and empty texts count no characters and are drawn like others of their
    source, but a source without any character vanishes. Repeated doc_ids draw the same count, each row for itself.
    Further columns pass. An empty table stays empty.
    """
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of at most 65,536 padded words.

    Null and empty texts have length 0 and are packed with the shortest. Repeated rows and null doc_ids are packed like others.
    Further columns pass, but those of the result (n_tokens, bucket, padded_to, batch, slot) are replaced. An empty
    table stays empty.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_neardup", near_dedup), ("mix_sources", mixing), ("pack", packing)]

#: The first and third stage are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
