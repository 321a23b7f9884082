"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.scratch import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(v, c): each linked vertex and the smallest vertex that it reaches. Links and labels stay distributed; every round is written to the shared folder.

    Nulls don't link; loops and repeated links do no harm. No links, no rows. The result goes with scratch, if that is given.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst")
    nodes = both.select(F.col("src").alias("v")).union(both.select("dst")).distinct()
    return graph.components(both, nodes, "v", scratch).withColumnRenamed("component", "c")
