"""Connected components of an edge table, by label propagation with pointer jumping, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmatrix.llm.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the least id of the component) of every end of the edges ``a``, ``b``.

    Each round takes the least label of the neighbours and then the label of
    that label, so chains shorten by half; only whether a label changed comes
    to the driver.  Labels are a stored table every round, the last one's goes
    when the next is there.  (A checkpoint would hand the planner's estimate of
    its size on, which joins square in every round, to numbers that take longer
    to multiply than the round.)

    Defined results: an edge with a null end or with two equal ends is no edge;
    repeated edges count once; without edges there are no rows; other columns
    are ignored.
    """
    kept = edges.select("a", "b").where("a <> b")
    both, drop_both = stored(kept.unionAll(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, drop_labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new, drop_new = stored(lower.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        moved = new.where("old <> label").limit(1).count()
        drop_labels()
        labels, drop_labels = new.select("id", "label"), drop_new
        if not moved:
            drop_both()
            return labels
