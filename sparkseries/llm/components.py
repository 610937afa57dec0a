"""Connected components of an edge table, by contraction: no component or edge list leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseries.llm.tables import dropped, written


def relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after joining the classes that ``edges`` (a, b) between nodes connect.

    Every class goes to its smallest neighbour class at once, the edges follow, and this repeats until
    no edge is left.  Labels are hashes, so each round removes a constant share of the classes.  Each
    round works on the contracted edges only and is written to the shared folder.
    """
    e = edges.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a")
    e = e.join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b").where("la <> lb")
    e = written(e.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), "hooks")
        moved = F.coalesce("m", "label").alias("label")
        new = written(labels.join(to.withColumnRenamed("a", "label"), "label", "left").select("node", moved), "labels")
        ends = e.join(to.withColumnsRenamed({"a": "a", "m": "ma"}), "a", "left")
        ends = ends.join(to.withColumnsRenamed({"a": "b", "m": "mb"}), "b", "left")
        x, y = F.coalesce("ma", "a"), F.coalesce("mb", "b")
        rest = written(ends.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
        for old in (e, to, labels):
            dropped(old)
        labels, e = new, rest
    dropped(e)
    return labels
