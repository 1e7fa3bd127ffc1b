"""Connected components of a link table, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links, of longs -> ``(node, root)``, root being the smallest node reachable.

    Each round points every node at its smallest neighbour, follows that pointer once more,
    and replaces the links by links between what they point at; at least half of the nodes
    vanish each time, so there are about log2(longest chain) rounds. At the end the rounds'
    pointers are followed backwards. A hub's links are reduced to a minimum before the
    shuffle, and joins on a hub are ordinary joins that adaptive execution can split.

    Self links and repeated links are allowed; a link with a null end is ignored. No links
    give an empty result.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = saved(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        nearest = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        nearest = saved(nearest.withColumnRenamed("a", "node"), "pointers")
        second = nearest.select(F.col("node").alias("p"), F.col("p").alias("root"))
        pointers = saved(nearest.join(second, "p").select("node", "root"), "pointers")
        rounds.append(pointers)
        at_a = pointers.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = pointers.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("ra <> rb")
        edges = saved(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = rounds[-1]
    for pointers in reversed(rounds[:-1]):
        above = result.select(F.col("node").alias("root"), F.col("root").alias("top"))
        result = pointers.join(above, "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")
        )
    return result
