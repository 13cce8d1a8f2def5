"""Graphs: weak components, strong components, shortest times, transit trees.

Component and path loops keep only the frontier moving and cut lineage with tables in
the shared folder. Path search over a small network is sequential by nature: the network
is broadcast after a check of its size and origins are searched in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.scratch import Scratch

#: Arcs up to which a network is shipped to every task.
NETWORK_ARCS = 20_000_000


def _least_labels(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of nodes (id): the least id that edges lead to, each from a to b, the node's own included.

    Labels jump: a node takes the least label that it has an edge to, and then its label's
    own label.
    """
    labels = scratch.save(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("low"))
        up = low.select(F.col("id").alias("_i"), F.col("low").alias("_l"))
        new = scratch.save(low.join(up, F.col("low") == F.col("_i"), "left").select("id", "was", F.least("low", F.coalesce("_l", "low")).alias("component")), "labels")
        changed = not new.where("was <> component").isEmpty()
        scratch.drop(labels)
        labels = new
        if not changed:
            return labels.select("id", "component")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes (id) and edges (a, b): the least id reachable either way.

    As labels jump, rounds grow with the logarithm of the longest chain, not its length.
    """
    scratch = Scratch(nodes.sparkSession, "weak")
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    return _least_labels(nodes, both, scratch)


def _both_ways(arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, to, of) of the ends of arcs (a, b): the least id that each reaches, and the least that reaches it.

    Both are found in the same rounds, their labels jumping as above.
    """
    ends = arcs.select(F.col("a").alias("id")).union(arcs.select("b")).distinct()
    labels = scratch.save(ends.select("id", F.col("id").alias("to"), F.col("id").alias("of")), "labels")
    # who looks at whom: tails at heads for to, heads at tails for of
    looks = scratch.save(arcs.select("a", "b", F.lit(True).alias("on")).union(arcs.select("b", "a", F.lit(False))), "looks")
    while True:
        seen = looks.join(labels, looks.b == labels.id)
        near = seen.groupBy("a").agg(F.min(F.when(F.col("on"), F.col("to"))).alias("t"), F.min(F.when(~F.col("on"), F.col("of"))).alias("o"))
        low = labels.join(near, labels.id == near.a).select("id", F.col("to").alias("was_to"), F.col("of").alias("was_of"), F.least("to", "t").alias("to"), F.least("of", "o").alias("of"))
        by_to, by_of = (low.select(F.col("id").alias(f"_{c}"), F.col(c).alias(f"_{c}l")) for c in ("to", "of"))
        jumped = low.join(by_to, F.col("to") == F.col("_to")).join(by_of, F.col("of") == F.col("_of"))
        new = scratch.save(jumped.select("id", F.least("to", "_tol").alias("to"), F.least("of", "_ofl").alias("of"), "was_to", "was_of"), "labels")
        scratch.drop(labels)
        labels = new
        if new.where("was_to <> to OR was_of <> of").isEmpty():
            return labels.select("id", "to", "of")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reachable and reaches back.

    Each node gets the least id that it reaches and the least that reaches it. Where these
    are one, that is its component. Nodes of one component have both alike, so edges
    between others go, and the rest is looked at again until no edge is left. What is held
    is nodes and edges, never pairs with a way between them. Edges may have ends that are
    not nodes; a way through them counts.
    """
    scratch = Scratch(nodes.sparkSession, "strong")
    arcs = scratch.save(edges.where("a <> b").select("a", "b").distinct(), "arcs")
    found = nodes.where(F.lit(False)).select(F.col("id").alias("fid"), F.col("id").alias("component"))
    while not arcs.isEmpty():
        both = _both_ways(arcs, scratch)
        found = found.union(both.where("to = of").select("id", "to"))
        left = both.where("to <> of")
        tail, head = (left.select(F.col("id").alias(e), F.struct("to", "of").alias(f"of_{e}")) for e in ("a", "b"))
        rest = scratch.save(arcs.join(tail, "a").join(head, "b").where("of_a = of_b").select("a", "b"), "arcs")
        scratch.drop(arcs)
        arcs = rest
    return nodes.join(found, F.col("id") == F.col("fid"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _network(arcs: DataFrame) -> dict[int, list[tuple[int, int]]]:
    least = arcs.where("w > 0 AND src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    n = least.count()
    if n > NETWORK_ARCS:
        raise ValueError(f"{n} arcs exceed the {NETWORK_ARCS} that a task can hold; cut the network into regions")
    out: dict[int, list[tuple[int, int]]] = {}
    for r in least.collect():
        out.setdefault(r.src, []).append((r.dst, r.w))
    return out


def dijkstra(net: dict[int, list[tuple[int, int]]], origin: int) -> dict[int, int]:
    """Times from one origin to all nodes that it reaches; equal times settle the smaller node first."""
    best, heap = {origin: 0}, [(0, origin)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in net.get(u, ()):
            if d + w < best.get(v, 1 << 62):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def shortest_times(arcs: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, node, time) from every origin (id), searched in parallel over the shipped network."""
    net = origins.sparkSession.sparkContext.broadcast(_network(arcs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for o in b["id"]:
                t = dijkstra(net.value, int(o))
                yield pd.DataFrame({"origin": int(o), "node": list(t), "time": list(t.values())})

    return origins.select("id").distinct().mapInPandas(run, "origin long, node long, time long")
