"""Graphs as edge tables: co-occurrence, label propagation, components, betweenness and communities."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import discard, settled
from . import similarity

#: A graph of more edges isn't held by every task; its shortest paths are found by joins.
MOST_EDGES = 2_000_000


def co_edges(df: DataFrame, user: str, item: str, threshold: int) -> DataFrame:
    """src, dst (src < dst), common: users who share `threshold` items or more."""
    if threshold < 1:
        raise ValueError("users without a common item can't be told apart from strangers: threshold must be 1 or more")
    sets = similarity.as_lists(df.select(F.col(user).alias("id"), F.col(item).alias("element")))
    found = similarity.overlaps(sets, lambda n: n - threshold + 1, lambda n, m: F.lit(threshold))
    # Those who use the edges read them more than once.
    return settled(found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "common"), "edges")


def both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(ways)).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("id")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after synchronous rounds: the label most neighbours have, the least of ties."""
    links = settled(both_ways(edges), "links")
    labels = links.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = links.join(labels, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.count("*").alias("n"))
        now = settled(votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")), "labels")
        discard(labels)
        labels = now
    # Nothing reads them after the last round; without a round labels are still made of them.
    if rounds:
        discard(links)
    return labels


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id): every round halves the way, as ids follow their label's label."""
    links = settled(both_ways(edges), "links")
    labels = settled(links.select(F.col("src").alias("id"), F.col("src").alias("component")).distinct(), "labels")
    while True:
        near = links.join(labels, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("seen"))
        # Written down: both sides of the jump would make it anew.
        now = settled(labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("seen", "component")).alias("component")), "near")
        up = now.select(F.col("id").alias("component"), F.col("component").alias("top"))
        jumped = settled(now.join(up, "component").select("id", F.col("top").alias("component")), "labels")
        done = jumped.join(labels, ["id", "component"], "left_anti").isEmpty()
        discard(now, labels)
        labels = jumped
        if done:
            discard(links)
            return labels


def members(labels: DataFrame, label: str) -> DataFrame:
    """members (sorted array) of each community, by size and members."""
    return labels.groupBy(label).agg(F.array_sort(F.collect_list("id")).alias("members")).select("members").orderBy(F.size("members"), "members")


def betweenness_by_joins(edges: DataFrame) -> DataFrame:
    """src, dst, betweenness: breadth-first search from all roots at once, a join of the frontier for each level, then credit back up.

    A vertex beside level d is in level d - 1, d or d + 1, so only two levels are looked back.
    """
    links = settled(both_ways(edges), "links")
    levels = [settled(links.select(F.col("src").alias("root"), F.col("src").alias("v"), F.lit(1.0).alias("paths")).distinct(), "level")]
    while True:
        reached = levels[-1].join(links, F.col("v") == F.col("src")).groupBy("root", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        for level in levels[-2:]:
            reached = reached.join(level.select("root", "v"), ["root", "v"], "left_anti")
        reached = settled(reached, "level")
        if reached.isEmpty():
            break
        levels.append(reached)
    parts, owed = [], None
    for above, level in zip(levels[-2::-1], levels[:0:-1], strict=True):
        credit = level.withColumn("credit", F.lit(1.0)) if owed is None else level.join(owed, ["root", "v"], "left").withColumn("credit", 1.0 + F.coalesce("owed", F.lit(0.0)))
        parents = above.select("root", F.col("v").alias("p"), F.col("paths").alias("p_paths"))
        shares = credit.join(links, F.col("v") == F.col("dst")).select("root", "v", F.col("src").alias("p"), "credit", "paths").join(parents, ["root", "p"])
        shares = settled(shares.select("root", "v", "p", (F.col("credit") * F.col("p_paths") / F.col("paths")).alias("share")), "shares")
        owed = shares.groupBy("root", F.col("p").alias("v")).agg(F.sum("share").alias("owed"))
        parts.append(shares.select(F.least("v", "p").alias("src"), F.greatest("v", "p").alias("dst"), "share"))
    if not parts:
        return links.select("src", "dst", F.lit(0.0).alias("betweenness")).limit(0)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("src", "dst").agg((F.sum("share") / 2).alias("betweenness")).orderBy(F.desc("betweenness"), "src", "dst")


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """src, dst (src < dst), betweenness over shortest paths.

    Roots are dealt to tasks, each of which holds the edges if a count of them allows; else it goes by joins.
    """
    # Written down: the count, the driver and the roots would each make the edges anew.
    undirected = settled(both_ways(edges).where("src < dst"), "whole")
    if undirected.count() > MOST_EDGES:
        return betweenness_by_joins(undirected)
    spark = edges.sparkSession
    near: dict = {}
    for a, b in undirected.collect():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    held = spark.sparkContext.broadcast({k: sorted(v) for k, v in near.items()})
    schema = undirected.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, total = held.value, {}
        for batch in batches:
            for root in batch.column("id").to_pylist():
                depth, paths, order, todo = {root: 0}, {root: 1.0}, [], deque([root])
                while todo:
                    v = todo.popleft()
                    order.append(v)
                    for w in graph[v]:
                        if w not in depth:
                            depth[w], paths[w] = depth[v] + 1, 0.0
                            todo.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] += paths[v]
                credit = dict.fromkeys(order, 1.0)
                for w in reversed(order):
                    for v in graph[w]:
                        if depth[v] == depth[w] - 1:
                            share = credit[w] * paths[v] / paths[w]
                            credit[v] += share
                            key = (min(v, w), max(v, w))
                            total[key] = total.get(key, 0.0) + share
        keys = list(total)
        kind = [pa.array([k[i] for k in keys], t) for i, t in ((0, types[0]), (1, types[1]))]
        yield pa.RecordBatch.from_arrays([*kind, pa.array([total[k] for k in keys], pa.float64())], ["src", "dst", "part"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(schema[c].dataType) for c in ("src", "dst")]
    spec = f"src {schema['src'].dataType.simpleString()}, dst {schema['dst'].dataType.simpleString()}, part double"
    roots = vertices(undirected).repartition("id")
    parts = roots.mapInArrow(run, spec)
    out = parts.groupBy("src", "dst").agg((F.sum("part") / 2).alias("betweenness")).orderBy(F.desc("betweenness"), "src", "dst")
    # Whoever has collected them may discard what they were read from.
    out.settled_at = undirected.settled_at
    return out


def modularity(edges: DataFrame, labels: DataFrame, degrees_of: DataFrame | None = None) -> float:
    """Of the partition labels (id, component). Degrees come from `degrees_of`, if given, else from edges.

    sum over ordered pairs of a group (A - k k / 2m) / 2m, with the pair of a vertex
    and itself; grouped sums replace the pairs.
    """
    m = both_ways(edges).count() / 2
    if m == 0:
        return 0.0
    a, b = labels.select(F.col("id").alias("src"), F.col("component").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    inside = both_ways(edges).join(a, "src").join(b, "dst").where("ca = cb").count()
    degree = both_ways(degrees_of if degrees_of is not None else edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    squares = labels.join(degree, "id").groupBy("component").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0
    return (inside - squares / (2 * m)) / (2 * m)


def local_components(edges: list[tuple], ids: list) -> dict:
    """Least id of each vertex's component."""
    parent = {v: v for v in ids}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in ids}


def girvan_newman(edges: DataFrame, textbook: bool = False) -> DataFrame:
    """id, component of the partition before modularity first falls.

    Each round cuts all edges of the highest betweenness (rounded to 5 places).
    Adjacency and m are of the whole graph; degrees are of what is left of it, or of
    the whole graph if `textbook`. The edges, whose number `edge_betweenness` checks,
    are on the driver; betweenness is worked out by the executors.
    """
    spark = edges.sparkSession
    undirected = settled(both_ways(edges).where("src < dst"), "whole")
    kind = undirected.schema["src"].dataType.simpleString()
    left, best, best_q = undirected, None, None
    whole: list[tuple] | None = None
    while True:
        found = edge_betweenness(left)
        ranked = [(r.src, r.dst, round(r.betweenness, 5)) for r in found.collect()]
        discard(found, left)
        remaining = [(a, b) for a, b, _ in ranked]
        if whole is None:
            whole, ids = remaining, sorted({v for e in remaining for v in e})
            if not whole:
                return spark.createDataFrame([], f"id {kind}, component {kind}")
        group = local_components(remaining, ids)
        m, degree = len(whole), dict.fromkeys(ids, 0)
        for a, b in whole if textbook else remaining:
            degree[a] += 1
            degree[b] += 1
        totals: dict = {}
        for v in ids:
            totals[group[v]] = totals.get(group[v], 0) + degree[v]
        inside = 2 * sum(group[a] == group[b] for a, b in whole)
        q = (inside - sum(k * k for k in totals.values()) / (2 * m)) / (2 * m)
        if best_q is not None and q < best_q:
            break
        best, best_q = group, q
        top = max((x for _, _, x in ranked), default=None)
        keep = [(a, b) for a, b, x in ranked if x < top] if ranked else []
        if not keep:
            break
        left = spark.createDataFrame(keep, f"src {kind}, dst {kind}")
    return spark.createDataFrame(sorted(best.items()), f"id {kind}, component {kind}")
