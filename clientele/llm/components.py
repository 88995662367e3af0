"""Connected components of a graph given as links between 64-bit nodes."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.frames import kept


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect: every node to the smallest one of its group."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    left, right = places[: len(a)], places[len(a) :]
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


# Up to so many links (16 bytes each) are joined in one task; more by rounds over all of them. The result is the same.
ONE_TASK_LINKS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint) that is not itself the smallest of its component, the root.

    Rounds of two steps: every node hands its smallest neighbour to its larger neighbours, then to its smaller
    ones. Neighbours meet in an aggregate (a minimum, combined before the shuffle) and a join, whose skewed
    partitions Spark splits, never in a collected group. The rounds grow with the logarithm of the size of
    a component. Each round's table goes to the shared folder; only its row count and checksum reach the driver.
    """
    links = kept(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    if state[0] <= ONE_TASK_LINKS:
        return kept(links.coalesce(1).mapInPandas(_joined, "node bigint, root bigint"), "roots")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        # a < b everywhere: b hands its smallest neighbour to the others.
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        met = large.join(least, F.col("b") == F.col("n"))
        small = met.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        links = kept(small, "links")
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _joined(frames):
    parts = [(f["a"].to_numpy(), f["b"].to_numpy()) for f in frames]
    if parts:
        root, node = forest(*(np.concatenate(side) for side in zip(*parts)))
        yield pd.DataFrame({"node": node, "root": root})


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
    return tuple(row)
