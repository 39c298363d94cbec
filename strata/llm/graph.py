"""Helpers for similarity graphs: comparing the members of groups in blocks, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b) of longs; a component is its smallest node.

    In each round every node that has a smaller neighbour takes the smallest as its parent, parents are
    replaced by their own until all are roots, edges are drawn between roots instead, and those within one
    root go. Every step, about as many as the logarithm of the longest path, is written to the shared folder;
    nothing is collected but whether something is left to do.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = written(edges.where("a <> b").select(*ends("a", "b")).distinct(), "cc-edges")
    label = None
    while True:
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parent = written(near.select("node", F.least("node", "near").alias("parent")), "cc-parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            step = written(parent.join(up, "parent").select("node", "parent", "up"), "cc-parents")
            discard(parent)
            parent = step.select("node", F.col("up").alias("parent"))
            if step.where("up <> parent").isEmpty():
                break
        if label is None:
            after = written(parent.select("node", F.col("parent").alias("component")), "cc-labels")
        else:
            p = parent.select(F.col("node").alias("component"), "parent")
            after = written(label.join(p, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "cc-labels")
            discard(label)
        label = after
        x = left.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        x = x.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b").where("pa <> pb")
        rest = written(x.select(*ends("pa", "pb")).distinct(), "cc-edges")
        discard(left, parent)
        left = rest
        if left.isEmpty():
            discard(left)
            return label


def block_pairs(rows: DataFrame, group: str, node: str, blocks: Column) -> DataFrame:
    """Deal a group's rows to pairs of blocks, so that any two rows meet in exactly one place.

    ``blocks``: into how many blocks the row's group is cut. Adds ``i``, ``j`` (the pair) and ``side``
    (the row's own block). A row of a group with k blocks comes out k times, never with each partner.
    """
    x = rows.withColumn("__k", blocks.cast("int")).withColumn("side", F.pmod(F.xxhash64(node), F.col("__k")).cast("int"))
    x = x.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    x = x.withColumn("i", F.least("side", "__o")).withColumn("j", F.greatest("side", "__o")).drop("__k", "__o")
    return x.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", node)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal (non-null integer) keys, across Arrow batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, pairs: Iterator[tuple[int, int]] | list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join parts not joined before: a spanning forest."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[y] = x
            kept.append((a, b))
    return kept
