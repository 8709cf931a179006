"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.session import gathered, written

# Links that a task holds at once.
HELD = 1 << 19


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them and itself.

    ``larger_only`` relinks the larger neighbours (large star); else the smaller ones and the node (small star).
    """
    both = edges if not larger_only else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if larger_only:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _star_links(links: pd.DataFrame) -> pd.DataFrame:
    """Links of every node of some links to the least node that it reaches by them."""
    codes, nodes = pd.factorize(pd.concat([links["u"], links["v"]], ignore_index=True), sort=True)
    i, j = codes[: len(links)], codes[len(links) :]
    label = np.arange(len(nodes))
    while (label[i] != label[j]).any():
        x, y = label[i], label[j]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label != label[label]).any():
            label = label[label]
    apart = label != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[apart], "v": nodes[label[apart]]})


def _stars_of_tasks(edges: DataFrame) -> DataFrame:
    """The links of each task brought down to stars, a bounded number of them at a time; components stay whole."""

    def relink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0
        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting > HELD:
                yield _star_links(pd.concat(held, ignore_index=True))
                held, waiting = [], 0
        if waiting:
            yield _star_links(pd.concat(held, ignore_index=True))

    return edges.mapInPandas(relink, edges.schema)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a lesser one, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node that each linked node reaches; nodes without links do not appear.

    Alternates two relinkings, each of which keeps components whole, until the links form stars around the least
    nodes. Rounds grow with the logarithm of a component's size at most; a task first brings the links it reads down to
    stars, so few are needed. Every node's links are reduced to their least one before they meet, and each round is a
    written table, in as many tasks as its links need.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = links.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v"))
    edges = written(_stars_of_tasks(edges), "links")
    while not _are_stars(edges):
        rows = 2 * edges.count()
        larger = gathered(_to_least(edges, True), rows)
        edges = written(_stars_of_tasks(gathered(_to_least(larger, False), rows)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
