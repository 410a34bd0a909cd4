"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> byte-level BPE. All but the last
keep the columns of documents. Counted as part of attestry.llm.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import bpe, decontaminate, line_dedup, partenum, toxicity
from attestry.llm.common import fresh, small_side, table, work_dir, written

#: A document that scores at least this much is rejected.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the classifier is trained on the labelled rows of the input.

    Null, empty and blank texts get the bias' score and stay; repeated rows are judged alike; a column named `score` is
    kept as it is. Without labels nothing is rejected. An empty table gives an empty one.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    into = fresh(docs, "score")
    return toxicity.score(docs, model, into).where(F.col(into) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose words equal or nearly equal those of an earlier line of the corpus.

    Documents without words, or left without any, go: null, empty and blank texts, and copies of what stands earlier.
    Repeated rows lose the same lines. n_chars follows the text, all other columns of any name stay.
    """
    return line_dedup.dedup_lines(docs).where(F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each near-duplicate class, that with the smallest doc_id, null last; repeated rows count once.

    Texts that share a doc_id are judged one by one; in one class the smaller text_key stays. Null, empty and blank
    texts are in no class and stay. Columns of any name stay as they are.
    """
    d, t = fresh(docs, "d"), fresh(docs, "t")
    classes = partenum.near_classes(docs).where(F.col("class_id").isNotNull())
    classes = written(classes.select("class_id", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key").alias("at")), "classes")
    first = classes.groupBy("class_id").agg(F.min("at").alias("first"), F.max("at").alias("other")).where("first <> other").select("class_id", "first")
    dropped = classes.join(first, "class_id").where("at <> first").select(F.col("at.doc_id").alias(d), F.col("at.text_key").alias(t))
    dropped, _ = small_side(written(dropped.distinct(), "dropped"))
    same = docs["doc_id"].eqNullSafe(dropped[d]) & (partenum.text_key(docs["text"]) == dropped[t])
    return docs.join(dropped, same, "left_anti").dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together; null item_ids are no items.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes of ids and of the text they decode to.

    Null texts count as empty; a row for each input row; only doc_id and what bpe.encode adds are returned.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", one_of_each_class),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Training and byte-pair merging are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
