"""Graph analytics over an edge relation (src, dst, strength, ...).

Traversals are unrolled equi-joins, iterations are joins and aggregations whose lineage is cut every few rounds, and
nothing holds the graph on the driver.  Source-parallel algorithms broadcast an adjacency whose size is checked.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from engramlake.functions import scores as S
from engramlake.lineage import cut, discard

#: Edges of the largest graph whose ranks are iterated in one task; some 40 bytes each there.
ONE_TASK_EDGES = 1_000_000
#: Edges of the largest graph whose adjacency is broadcast.
MAX_BROADCAST_EDGES = 2_000_000
CUT_EVERY = 5
#: Levels of a breadth-first search that are read as tables of their own.
LEVELS = 20


def undirected(edges: DataFrame, weight: str = "strength") -> DataFrame:
    """(src, dst, w) in both directions, the strongest edge of each pair."""
    e = edges.where("src <> dst").select("src", "dst", F.col(weight).alias("w"))
    return e.union(e.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def traverse(edges: DataFrame, start: str, depth: int, limit: int = 50) -> DataFrame:
    """Walks from ``start`` along edges, repeats kept: (node, depth, strength), nearest and strongest first."""
    e = edges.select("src", "dst", F.col("strength").alias("s"))
    level = e.where(F.col("src") == start).select(F.col("dst").alias("node"), F.lit(1).alias("depth"), F.col("s").alias("strength"))
    out = level
    for k in range(2, depth + 1):
        level = level.join(e, level.node == e.src).select(F.col("dst").alias("node"), F.lit(k).alias("depth"), F.col("s").alias("strength"))
        out = out.union(level)
    return out.orderBy("depth", F.desc("strength"), "node").limit(limit)


def paths(edges: DataFrame, starts: Column, depth: int, reverse: bool = False) -> DataFrame:
    """Simple paths of up to ``depth`` edges from the nodes in ``starts``: (node, depth, strength, path)."""
    e = edges.select(F.col("dst" if reverse else "src").alias("x"), F.col("src" if reverse else "dst").alias("y"), F.col("strength").alias("s"))
    level = e.where(starts).select(F.col("y").alias("node"), F.lit(1).alias("depth"), F.col("s").alias("strength"), F.array("x", "y").alias("path"))
    out = level
    for k in range(2, depth + 1):
        level = level.join(e, (level.node == e.x) & ~F.array_contains("path", F.col("y"))).select(
            F.col("y").alias("node"), F.lit(k).alias("depth"), (F.col("strength") * F.col("s")).alias("strength"), F.concat("path", F.array("y")).alias("path"))
        out = out.union(level)
    return out


def infer(edges: DataFrame, start: str, depth: int, limit: int = 20) -> DataFrame:
    """Transitive edges: products of strengths along walks of two edges or more."""
    e = edges.select("src", "dst", F.col("strength").alias("s"))
    level = e.where(F.col("src") == start).select(F.col("dst").alias("node"), F.col("s").alias("strength"))
    out = None
    for k in range(2, depth + 1):
        level = level.join(e, level.node == e.src).select(F.col("dst").alias("node"), (F.col("strength") * F.col("s")).alias("strength"))
        found = level.withColumn("depth", F.lit(k))
        out = found if out is None else out.union(found)
    return out.select("node", "depth", F.round("strength", 8).alias("strength")).orderBy(F.desc("strength"), "depth", "node").limit(limit)


def activate(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.85) -> DataFrame:
    """Spreading activation over undirected edges: a node takes the largest of its own and its neighbours' decayed
    activation times the edge's strength (kept within 0.01 and 1)."""
    e = undirected(edges).withColumn("w", S.clamp(F.col("w"), 0.01, 1.0))
    a = seeds.select(F.col("node"), F.lit(1.0).alias("a"))
    for _ in range(hops):
        spread = a.join(e, a.node == e.src).select(F.col("dst").alias("node"), (F.col("a") * decay * F.col("w")).alias("a"))
        a = a.union(spread).groupBy("node").agg(F.max("a").alias("a"))
    return a


def predict_links(edges: DataFrame, start) -> DataFrame:
    """Adamic-Adar scores of nodes two steps away that aren't neighbours: (candidate, score)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    degree = both.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("degree"))
    near = both.where(F.col("src") == start).select(F.col("dst").alias("via")).distinct()
    two = near.join(both, F.col("via") == F.col("src")).select("via", F.col("dst").alias("candidate")).where(F.col("candidate") != start).distinct()
    fresh = two.join(near.select(F.col("via").alias("candidate")), "candidate", "left_anti")
    return fresh.join(degree, "via").groupBy("candidate").agg(F.sum(S.adamic_adar(F.col("degree"))).alias("score"))


def transitions(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, p) with rows summing to 1, and the nodes that have an edge with whether they are dangling."""
    e = cut(edges.groupBy("src", "dst").agg(F.sum("strength").alias("s")), "edges")
    out = e.groupBy("src").agg(F.sum("s").alias("t"))
    p = e.join(out, "src").where("t > 0").select("src", "dst", (F.col("s") / F.col("t")).alias("p"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    sources = p.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True))
    return p, nodes.join(sources, "node", "left").select("node", F.col("out").isNull().alias("dangling"))


def page_rank(edges: DataFrame, seeds: list | None = None, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(node, rank) after fixed iterations.  Without seeds teleport and dangling mass go to all nodes, with seeds to
    the seeds.  Scores start uniform.  A stored graph of up to ``ONE_TASK_EDGES`` edges needs no exchange and is iterated
    in one task, by the same sums."""
    p, nodes = transitions(edges)
    p, nodes = cut(p, "transition"), cut(nodes, "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    share = F.lit(1.0 / n) if not seeds else F.when(F.col("node").isin(seeds), 1.0 / len(seeds)).otherwise(0.0)
    ranks = nodes.select("node", "dangling", share.alias("share"), F.lit(1.0 / n).alias("rank"))
    if n <= ONE_TASK_EDGES and p.count() <= ONE_TASK_EDGES:
        return _rank_in_one_task(ranks, p, damping, iterations)
    stored = None
    for k in range(1, iterations + 1):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = ranks.join(p, ranks.node == p.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        step = ranks.join(got, "node", "left").crossJoin(F.broadcast(lost))
        ranks = step.select("node", "dangling", "share", (
            (1 - damping) * F.col("share") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("share"))).alias("rank"))
        if k % CUT_EVERY == 0:
            last, ranks = stored, cut(ranks, "rank")
            stored = ranks
            if last is not None:
                discard(last)
    return ranks.select("node", "rank")


def _rank_in_one_task(ranks: DataFrame, p: DataFrame, damping: float, iterations: int) -> DataFrame:
    kind = ranks.schema["node"].dataType
    nodes = ranks.select("node", F.lit(None).cast(kind).alias("dst"), F.col("share").alias("p"), "rank", "dangling")
    both = nodes.union(p.select("src", "dst", "p", F.lit(0.0), F.lit(False)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(parts)
        own = t["dst"].isna().to_numpy()
        n, e = t[own], t[~own]
        place = pd.Index(n["node"])
        src, dst, p = place.get_indexer(e["node"]), place.get_indexer(e["dst"]), e["p"].to_numpy()
        share, rank, dangling = n["p"].to_numpy(), n["rank"].to_numpy(), n["dangling"].to_numpy(dtype=bool)
        for _ in range(iterations):
            got = np.bincount(dst, rank[src] * p, len(rank)) if len(e) else 0.0
            rank = (1 - damping) * share + damping * (got + rank[dangling].sum() * share)
        yield pd.DataFrame({"node": n["node"].to_numpy(), "rank": rank})

    return both.coalesce(1).mapInPandas(run, f"node {kind.simpleString()}, rank double")


def normalised(ranks: DataFrame) -> DataFrame:
    """Scores scaled to 0..1; none where they are all alike."""
    ends = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    wide = ranks.crossJoin(F.broadcast(ends)).where("hi - lo >= 1e-10")
    return wide.select("node", ((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("rank"))


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, d): breadth-first distances, first seen wins, level by level until nothing is new, or to ``most``."""
    e = cut(edges.select("src", "dst").distinct(), "edges")
    frontier = sources.select(F.col("node").alias("source"), "node")
    seen = cut(frontier.withColumn("d", F.lit(0)), "bfs")
    last, k = seen, 0
    while k != most and last.limit(1).count():
        k += 1
        step = last.join(e, last.node == e.src).select("source", F.col("dst").alias("node")).distinct()
        last = cut(step.join(seen, ["source", "node"], "left_anti").withColumn("d", F.lit(k)), "bfs")
        seen = seen.union(last) if k % LEVELS else cut(seen.union(last), "bfs")
    return seen


def closeness(edges: DataFrame) -> DataFrame:
    """(node, harmonic, closeness) of nodes with an out-edge; two-way edges count in both directions."""
    e = edges.select("src", "dst").union(edges.where("bidirectional").select("dst", "src")).distinct()
    d = distances(e, e.select(F.col("src").alias("node")).distinct())
    away = F.when(F.col("d") > 0, F.col("d"))
    return d.groupBy(F.col("source").alias("node")).agg(
        F.coalesce(F.sum(1 / away), F.lit(0.0)).alias("harmonic"), F.coalesce(F.count(away) / F.sum(away), F.lit(0.0)).alias("closeness"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): nodes with fewer than k neighbours leave until none does; what stays has a core number of its least
    degree at least, so that k goes on from there."""
    e = cut(undirected(edges).select("src", "dst"), "core")
    out = None
    while True:
        least = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
        if least is None:
            break
        inside = e.select(F.col("src").alias("node"), F.lit(least).cast("int").alias("core")).distinct()
        out = inside if out is None else out.union(inside)
        k = least + 1
        while True:
            stay = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("src").alias("node"))
            rest = cut(e.join(stay, e.src == stay.node, "left_semi").join(stay, e.dst == stay.node, "left_semi"), "core")
            if rest.count() == e.count():
                discard(rest)
                break
            e = rest
    if out is None:
        return e.select(F.col("src").alias("node"), F.lit(0).alias("core"))
    return out.groupBy("node").agg(F.max("core").alias("core"))


def betweenness(edges: DataFrame, partitions: int = 32) -> DataFrame:
    """(node, score): shortest-path betweenness over ordered sources on the undirected multigraph, divided by
    (n-1)(n-2)/2, so that scores reach 2.

    Trees that hang on the graph are folded into the node they hang on: all paths between two branches of a node pass
    it, so these are counted by sizes, and only the nodes that are left are sources, weighted by what they hold.  Sources are
    spread over tasks; the adjacency is broadcast after its size was checked, and larger graphs are refused: the
    algorithm costs nodes times edges of what is left, so it isn't meant for them."""
    e = cut(edges.select("src", "dst"), "edges")
    if e.limit(MAX_BROADCAST_EDGES + 1).count() > MAX_BROADCAST_EDGES:
        raise ValueError(f"betweenness takes graphs of up to {MAX_BROADCAST_EDGES} edges")
    number: dict = {}
    adjacency: list[dict] = []
    for a, b in e.collect():
        for x in (a, b):
            if x not in number:
                number[x] = len(adjacency)
                adjacency.append({})
        i, j = number[a], number[b]
        if i != j:
            adjacency[i][j] = adjacency[i].get(j, 0) + 1
            adjacency[j][i] = adjacency[j].get(i, 0) + 1
    n = len(adjacency)
    weight, branches = _fold(adjacency)
    size = _component_sizes(adjacency, weight, branches)
    own = [0.0] * n
    for v, below in enumerate(branches):
        rest = size[v] - weight[v]
        own[v] = float((size[v] - 1) ** 2 - sum(weight[c] ** 2 for c in below) - rest**2) if below else 0.0
    kept = [v for v in range(n) if adjacency[v]]
    shared = edges.sparkSession.sparkContext.broadcast(({v: list(adjacency[v].items()) for v in kept}, {v: weight[v] for v in kept}))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        graph, held = shared.value
        for p in parts:
            for source in p["node"].tolist():
                reached, ways, before = {source: 0}, {source: 1.0}, {}
                order, queue = [], deque([source])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w, times in graph[v]:
                        if w not in reached:
                            reached[w] = reached[v] + 1
                            queue.append(w)
                        if reached[w] == reached[v] + 1:
                            ways[w] = ways.get(w, 0.0) + ways[v] * times
                            before.setdefault(w, []).append((v, times))
                share: dict = {}
                for w in reversed(order):
                    for v, times in before.get(w, ()):
                        share[v] = share.get(v, 0.0) + ways[v] * times / ways[w] * (held[w] + share.get(w, 0.0))
                    if w != source and share.get(w):
                        total[w] = total.get(w, 0.0) + held[source] * share[w]
        yield pd.DataFrame({"node": pd.Series(list(total), dtype="int64"), "score": pd.Series(list(total.values()), dtype=float)})

    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    scale = (n - 1) * (n - 2) / 2 if n > 2 else 1.0
    sources = spark.createDataFrame([(v,) for v in kept], "node long").repartition(partitions, "node")
    passed = sources.mapInPandas(run, "node long, score double")
    folded = spark.createDataFrame([(v, own[v]) for v in range(n) if own[v]], "node long, score double")
    summed = passed.union(folded).groupBy("node").agg(F.sum("score").alias("score"))
    names = spark.createDataFrame([(i, x) for x, i in number.items()], StructType([StructField("i", LongType()), StructField("name", kind)]))
    return summed.join(names, summed.node == names.i).select(F.col("name").alias("node"), (F.col("score") / scale).alias("score"))


def _fold(adjacency: list[dict]) -> tuple[list[int], list[list[int]]]:
    """(weight, branches) of each node, itself and all folded below it counted; nodes with one neighbour, again and again,
    are taken out of ``adjacency`` and become branches of that neighbour."""
    weight, branches = [1] * len(adjacency), [[] for _ in adjacency]
    ends = deque(v for v, near in enumerate(adjacency) if len(near) == 1)
    while ends:
        v = ends.popleft()
        if len(adjacency[v]) != 1:  # its last neighbour was folded into it
            continue
        (up,) = adjacency[v]
        adjacency[v].clear()
        del adjacency[up][v]
        weight[up] += weight[v]
        branches[up].append(v)
        if len(adjacency[up]) == 1:
            ends.append(up)
    return weight, branches


def _component_sizes(adjacency: list[dict], weight: list[int], branches: list[list[int]]) -> list[int]:
    """Nodes of each node's connected part, of a graph that :func:`_fold` has folded."""
    size = [0] * len(adjacency)
    below = {c for b in branches for c in b}
    for root in range(len(adjacency)):
        if size[root] or root in below:
            continue
        part, queue = {root}, [root]
        while queue:
            for w in adjacency[queue.pop()]:
                if w not in part:
                    part.add(w)
                    queue.append(w)
        total, queue = sum(weight[v] for v in part), list(part)
        while queue:
            v = queue.pop()
            size[v] = total
            queue.extend(branches[v])
    return size


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least node that is connected with a node, by spreading minima until they settle."""
    e = cut(undirected(edges).select("src", "dst"), "edges")
    labels = cut(e.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct(), "labels")
    for _ in range(most):
        near = e.join(labels, e.dst == labels.node).select(F.col("src").alias("node"), "component")
        new = labels.union(near).groupBy("node").agg(F.min("component").alias("component"))
        # jump: a label's own label
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = cut(new.join(up, "component", "left").select("node", F.least("component", F.coalesce("higher", "component")).alias("component")), "labels")
        settled = not new.exceptAll(labels).limit(1).count()
        discard(labels)
        labels = new
        if settled:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")


def communities(edges: DataFrame, group: str | None = None, outer: int = 10, inner: int = 50) -> DataFrame:
    """(node, community): local moving by modularity gain, one level, then communities split into connected parts.

    Sequential over the nodes of one graph, so each graph (``group``, or all) is one task, for graphs that a
    task can hold; nodes are visited in order, and of equal gains the smallest community wins."""
    kind = edges.schema["src"].dataType.simpleString()
    g = edges.select(F.lit(0).alias("g") if group is None else F.col(group).alias("g"), "src", "dst", "strength")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, w in zip(p["src"], p["dst"], p["strength"]):
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        nodes = sorted(near)
        m2 = 2.0 * p["strength"].sum()
        strength = {v: sum(w for _, w in near[v]) for v in nodes}
        label = {v: v for v in nodes}
        for _ in range(outer):
            any_moved = False
            for _ in range(inner):
                moved = False
                total: dict = {}
                for v in nodes:
                    total[label[v]] = total.get(label[v], 0.0) + strength[v]
                for v in nodes:
                    inside: dict = {}
                    for u, w in near[v]:
                        inside[label[u]] = inside.get(label[u], 0.0) + w
                    here, k = label[v], strength[v]
                    best, gain = here, 0.0
                    for c in sorted(inside):
                        if c == here:
                            continue
                        d = (inside[c] - inside.get(here, 0.0)) * 2 / m2 + k * (total.get(here, 0.0) - k - total.get(c, 0.0)) / m2**2 * 2
                        if d > gain:
                            best, gain = c, d
                    if best != here:
                        total[here] -= k
                        total[best] = total.get(best, 0.0) + k
                        label[v] = best
                        moved = any_moved = True
                if not moved:
                    break
            if not any_moved:
                break
        part: dict = {}
        for v in nodes:  # connected parts, named by their least node
            if v in part:
                continue
            part[v], queue = v, deque([v])
            while queue:
                x = queue.popleft()
                for u, _ in near[x]:
                    if u not in part and label[u] == label[v]:
                        part[u] = v
                        queue.append(u)
        return pd.DataFrame({"g": p["g"].iloc[0], "node": nodes, "community": [part[v] for v in nodes]})

    return g.groupBy("g").applyInPandas(run, f"g int, node {kind}, community {kind}").drop("g")


def autolink(sessions: DataFrame, existing: DataFrame | None = None, shared: int = 2, least: float = 0.3) -> DataFrame:
    """(a, b, n, npmi): entities that share sessions, without an edge in either direction.  ``sessions`` holds
    distinct (session, entity)."""
    total = sessions.agg(F.countDistinct("session").alias("t"))
    count = sessions.groupBy("entity").agg(F.count(F.lit(1)).alias("c"))
    x, y = sessions.alias("x"), sessions.alias("y")
    pairs = x.join(y, (F.col("x.session") == F.col("y.session")) & (F.col("x.entity") < F.col("y.entity")))
    pairs = pairs.groupBy(F.col("x.entity").alias("a"), F.col("y.entity").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared)
    if existing is not None:
        known = existing.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    ca, cb = count.select(F.col("entity").alias("a"), F.col("c").alias("ca")), count.select(F.col("entity").alias("b"), F.col("c").alias("cb"))
    scored = pairs.join(ca, "a").join(cb, "b").crossJoin(F.broadcast(total))
    return scored.select("a", "b", "n", S.npmi(F.col("n"), F.col("ca"), F.col("cb"), F.col("t")).alias("npmi")).where(F.col("npmi") >= least)


def prune_paths(scored: DataFrame, group: str, nodes: int = 20, k: int = 5) -> DataFrame:
    """Per group the best paths within a budget of nodes, a path that would exceed it being passed over."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        used, keep = 0, []
        for i, row in enumerate(p.sort_values(["score", "id"], ascending=[False, True]).itertuples()):
            if len(keep) == k:
                break
            if used + row.n_nodes <= nodes or not keep:
                used += row.n_nodes
                keep.append(row.Index)
        return p.loc[keep]

    return scored.groupBy(group).applyInPandas(run, scored.schema)


def merge_groups(pairs: DataFrame, contradicting: DataFrame | None = None) -> DataFrame:
    """(node, component) of alike entities, without the groups that hold a contradicting pair."""
    groups = connected(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("strength")))
    if contradicting is None:
        return groups
    a = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    bad = contradicting.join(a, "a").join(b, "b").where("ca = cb").select(F.col("ca").alias("component")).distinct()
    return groups.join(bad, "component", "left_anti").select("node", "component")
