"""Documents with labels, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.checkpoint import settled

# Documented bound: at most this many labelled rows, those with the lowest hash of their id, are fitted on. Their ids and
# labels (12 bytes each) are broadcast, so texts are not shuffled.
LABELLED = 100_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int = LABELLED) -> DataFrame:
    """doc_id, text, label and tie (a hash of the id) of documents with a label of 0 or 1.

    Of contradicting labels for one id the highest counts; null ids and other labels take no part; null texts are empty. Of documents
    with equal texts and labels the one with the least id is taken, so copies do not weigh more.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
             .withColumn("tie", F.xxhash64("doc_id")).orderBy("tie", "doc_id").limit(bound))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    chosen = settled(texts.select("doc_id", F.xxhash64("text").alias("copy")).join(F.broadcast(settled(known)), "doc_id")
                     .groupBy("copy", "label").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
                     .select("first.doc_id", "label", "first.tie").dropDuplicates(["doc_id"]))
    return texts.join(F.broadcast(chosen), "doc_id")
