"""Shape of a reduction: a full binary tree whose 2^depth gaps hold chains, numbered in order.

Spark needs no such plan to add; it is kept for inspection and for the depth of a treeReduce.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a link moves during one call's latency: 9.68 * 2^30 / 8 B/s * 750 us.
BYTES_PER_LATENCY = 9.68 * 2**30 / 8 * 750e-6


@dataclass(frozen=True)
class Node:
    order: int
    parent: int | None
    is_tree: bool


@dataclass(frozen=True)
class Plan:
    depth: int
    chains: tuple[int, ...]
    nodes: tuple[Node, ...]


def chain_length(n_bytes: Column) -> Column:
    return F.round(n_bytes / F.lit(BYTES_PER_LATENCY)).cast("long")


def plan(objects: int, longest: int) -> Plan:
    """objects: how many are reduced; longest: the wished length of a chain."""
    if objects < 1 or longest < 0:
        raise ValueError("a plan needs an object, and chains of 0 or more")
    depth = max(0, min(math.ceil(math.log2((objects + 1) / (longest + 1))), int(math.log2(objects + 1))))
    inner, gaps = 2**depth - 1, 2**depth
    short, extra = divmod(objects - inner, gaps)
    chains = tuple(short + (i < extra) for i in range(gaps))
    # In-order: chain 0, tree node 0, chain 1, tree node 1, ... A tree node at in-order place p (from 1) stands as high as the power of two in p.
    tree_at, order = [], 0
    for length in chains:
        order += length
        tree_at.append(order)
        order += 1
    parent: dict[int, int | None] = {}
    for p in range(1, inner + 1):
        step = p & -p
        up = p - step if p & (2 * step) else p + step
        parent[tree_at[p - 1]] = tree_at[up - 1] if 0 < up <= inner and depth > 1 and step * 2 <= inner else None
    order = 0
    for g, length in enumerate(chains):
        for i in range(length):
            beyond = tree_at[max((c for c in (g - 1, g) if 0 <= c < inner), key=lambda c: -((c + 1) & -(c + 1)))] if inner else None
            parent[order] = order + 1 if i + 1 < length else beyond
            order += 1
        order += 1
    trees = set(tree_at[:inner])
    return Plan(depth, chains, tuple(Node(o, parent[o], o in trees) for o in range(objects)))


@F.udtf(returnType="ord int, parent int, is_tree boolean")
class PlanNodes:
    """The nodes of plan(objects, longest) as a table function."""

    def eval(self, objects: int, longest: int):
        for node in plan(objects, longest).nodes:
            yield node.order, node.parent, node.is_tree


def plans(reductions: DataFrame) -> DataFrame:
    """The nodes of each reduction of (..., objects, longest); one without objects has none."""
    return reductions.where("objects > 0").lateralJoin(PlanNodes(F.col("objects").cast("int").outer(), F.col("longest").cast("int").outer()))
