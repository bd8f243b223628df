"""Connected components of link tables, without gathering links anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginwatch.llm.common import map_batches, staged


def _roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node that each one reaches."""
    root = np.arange(max(a.max(initial=-1), b.max(initial=-1)) + 1)
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root[root] != root).any():
            root = root[root]


def _contracted(links: DataFrame) -> DataFrame:
    """(u, v), u > v: the same connections, with each batch of links made one star per component."""

    def make():
        def each(batch: pa.RecordBatch):
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _roots(at[: len(a)], at[len(a) :])
            moved = np.flatnonzero(root != np.arange(len(root)))
            return {"u": ids[moved], "v": ids[root[moved]]}

        return each

    kind = links.schema["a"].dataType.simpleString()
    return map_batches(links.select("a", "b"), f"u {kind}, v {kind}", make)


def _directed(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Each row once per pair of columns in ``ends``, as (u, v)."""
    pairs = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ends])
    return rows.select(F.inline(pairs))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or only larger ones."""
    up = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    down = edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    nodes = up.union(down).groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return not nodes.agg(F.coalesce(F.bool_or(F.col("up") + F.col("root") > 1), F.lit(False))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``links`` (a, b), itself included.

    Links of one Arrow batch, a bounded number, are first contracted to stars. Then large-star and
    small-star steps, which halve the distance to the smallest id, alternate until only stars are
    left; each round is written to the shared folder, so lineage stays short. A node's neighbours
    are never gathered: a step is a minimum per node, pre-aggregated, joined back to the links, and
    a hot node's join can be split.
    """
    edges = staged(_contracted(links.where("a <> b")).distinct())
    while not _are_stars(edges):
        # large star: every larger neighbour of u is linked with u's smallest one, or u itself
        both = _directed(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u, and u, are linked with the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _directed(large.join(least, "u"), ("v", "m"), ("u", "m"))
        edges = staged(small.where("u <> v").distinct())
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
