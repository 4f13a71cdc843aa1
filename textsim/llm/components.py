"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsim.session import materialize


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of links (a, b).

    Each round takes the smallest component among the neighbours (a partial
    aggregate, so a hub costs one row a task) and then follows the component's own
    component. The rounds needed grow with the logarithm of a chain's length.
    """
    both = links.select("a", "b").where("a <> b").distinct()
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    state = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "cc-state")
    while True:
        seen = both.join(state, both["b"] == state["id"]).groupBy("a").agg(F.min("component").alias("near"))
        closer = materialize(state.join(seen, state["id"] == seen["a"]).select(
            "id", "component", F.least("component", "near").alias("next")), "cc-next")
        roots = closer.select(F.col("id").alias("root"), F.col("next").alias("above"))
        moved = materialize(closer.join(roots, closer["next"] == roots["root"]).select("id", "component", "above"), "cc-jump")
        state = moved.select("id", F.col("above").alias("component"))
        if moved.where("component <> above").isEmpty():
            return state
