"""Bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` labelled documents of each label, with their whole texts.

    Rows are drawn by a hash of doc_id, so the draw does not depend on order.
    The counts of labels come first; rows above a label's share of the hash range
    never meet in a task, and the bound is then applied to the narrow rows left.
    Both broadcasts are bounded: by the labels a model can hold, and by the sample.
    ``labels`` holds doc_id and the label, one value each.
    """
    marked = labels.select("doc_id", F.col(label).alias("label")).where("label is not null")
    counts = marked.groupBy("label").count()
    draw = (F.xxhash64("doc_id", F.lit("draw")).bitwiseAND((1 << 40) - 1)) / (1 << 40)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))
    drawn = (
        marked.withColumn("draw", draw)
        .join(F.broadcast(counts), "label")
        .where(F.col("draw") * F.col("count") < 1.25 * per_label + 10)
        .withColumn("rank", rank)
        .where(F.col("rank") <= per_label)
        .select("doc_id", "label")
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")

