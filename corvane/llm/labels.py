"""A bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """docs (doc_id, text) with the column `target` of labels as `y` (long), for at most `most` labelled ids,
    chosen by a hash of the id.  Null ids, texts and labels take no part; of several labels of an id the
    largest counts.  The ids are few by that bound, so they are broadcast and no text is shuffled."""
    known = labels.where(f"doc_id IS NOT NULL AND {target} IS NOT NULL").groupBy("doc_id").agg(F.max(target).cast("long").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
