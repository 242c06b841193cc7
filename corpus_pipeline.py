"""From raw documents to packed sequences, in five stages, each over all that the one before kept.

quality    documents that the classifier does not select go
lines      later copies of repeated runs of lines are deleted; documents that were nothing else go
near       one row of each group of near duplicates stays, the one of smallest doc_id
leaks      documents that hold a benchmark passage go
packing    what is left is cut into sequences of 1024 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common as C
from corvane.llm.decontaminate import contaminated_ids
from corvane.llm.line_dedup import dedup_lines
from corvane.llm.ngram_join import near_duplicates
from corvane.llm.packing import pack
from corvane.llm.quality import fit, keep_good


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of doc_id and text, so that rows that share a doc_id, or have none, are told apart."""
    C.prepare(docs.sparkSession)
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled ones, selects.  Each row is judged by its text alone: null and
    empty texts count as texts without words, null and repeated doc_ids change nothing, repeated rows fare alike, and
    other columns pass as they are.  An empty table stays empty."""
    C.prepare(spark)
    return keep_good(docs, fit(docs, C.table(spark, sf_dir, "labels"), "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with repeated runs of lines deleted.  Rows that lose all their text go; null and blank ones, which
    had none to lose, went with them.  Rows with a null doc_id stay as they are; rows equal in doc_id and text are
    one document and fare alike.  An empty table stays empty."""
    C.prepare(spark)
    return dedup_lines(docs).where("text IS NOT NULL AND trim(text) <> ''")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of smallest doc_id, then text; null doc_ids come last.
    Rows are told apart by doc_id and text, so rows that share a doc_id only are judged each by its own text.  Null
    and empty texts are like nothing and stay, equal rows of them as often as they come.  An empty table stays empty."""
    keyed = _keyed(docs)
    found = C.cut(near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"))).select(F.col("doc_id").alias("__row"), "component_id", "n_shingles")
    many = found.where("n_shingles > 0").groupBy("component_id").count().where("count > 1").select("component_id")
    ids = C.cut(found.join(many, "component_id").select("__row", "component_id").distinct())
    maybe, rest = C.split_by_keys(keyed, ids.select("__row"), "__row")
    maybe = maybe.join(ids, "__row", "left")
    alone = maybe.where("component_id IS NULL").select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text", *others)
    first = maybe.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min(row).alias("row"))
    return first.select(*(F.col("row")[c].alias(c) for c in docs.columns)).union(alone).union(rest.select(*docs.columns))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage, each judged by its own text, whatever its doc_id.  Null and empty texts hold
    none and stay; equal rows fare alike.  An empty table stays empty, and without a benchmark all rows stay."""
    keyed = _keyed(docs)
    ids = C.cut(contaminated_ids(keyed.select(F.col("__row").alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", "__row"))
    maybe, rest = C.split_by_keys(keyed, ids, "__row")
    return maybe.join(ids, "__row", "left_anti").select(*docs.columns).union(rest.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with the ids.  A null or empty text is its end token alone; rows
    that share a doc_id are packed one after the other, each as a document.  An empty table gives no pieces."""
    import public_tokenizers

    C.prepare(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("leaks", leaks), ("packing", packing)]

#: The classifier, the tokenizer and the cuts cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again, and goes when the next one
    is written.  What the last stage reads stays until the session's shared folder is cleared."""
    import uuid

    folder = f"{C.checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            C.remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
