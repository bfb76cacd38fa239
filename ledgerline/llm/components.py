"""Connected components of a table of links, without a group or a link list in one task."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.shared import written


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the links a[i] - b[i], in numpy."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (label[left], label[right], left, right):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """The links of each batch as stars round the batch's smallest nodes: fewer rows, the same components."""
    for batch in batches:
        nodes, roots = local_components(batch["a"].to_numpy(), batch["b"].to_numpy())
        kept = nodes != roots
        yield pd.DataFrame({"a": nodes[kept], "b": roots[kept]})


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    # written, so that both sides of the join are plain shuffles and the many neighbours of a hub can be split
    larger = both.where("b > a").join(written(least, "least"), "a")
    return larger.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Needs a > b in every row."""
    least = written(links.groupBy("a").agg(F.min("b").alias("low")), "least")  # as above
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.where("a > b").unionAll(least.select("a", F.col("low").alias("b"))).distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")),
    )
    seen = links.select(F.inline(ends)).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.where("below > 1 or (below = 1 and above = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the long columns ``a`` and ``b``; component is its smallest node.

    Alternates large and small stars until each component is one star, so the number of rounds grows
    with the logarithm of the longest chain, and a hub is only ever joined and counted, never collected.
    Each round is written to the shared folder, which also cuts the lineage. Rows with a null end or two
    equal ends carry no link. The driver learns one boolean a round.
    """
    clean = links.select("a", "b").where("a != b")
    links = written(clean.mapInPandas(_contract, "a long, b long").distinct(), "links")
    while not _is_forest_of_stars(links):
        links = written(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
