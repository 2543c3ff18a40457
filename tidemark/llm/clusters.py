"""Clusters of mutually similar vectors by Markov clustering of their similarity graph.

The graph has an edge wherever two vectors are at least ``threshold`` similar; its edges come from the lists
of the inverted file (see ``vectors``). Within a list the flow matrix of all its
edges is squared, inflated and pruned until columns settle; each node goes to its attractor. The groups this makes are the nodes of a coarser
graph, with the sums of the edges between them, and flow is run on it again: in the neighbourhoods of nodes chosen by a hash that
changes from level to level, each settled in one task. What goes to one attractor becomes one node of the next level, and so on until no edge
leaves a node. Inflation cuts long chains at one level, the next joins their parts, so the last clusters are what chains of similar pairs
join, exactly. Every assignment on the way is one of settled flow.

The Markov clusters of one level, as ``p7_markov`` gives them, come from the whole graph of the lists' groups: its flow matrix is squared, inflated and
pruned until columns settle, a component in one task or, if it is too wide, as a distributed sparse matrix. They lie within the clusters.

A list hands on one row per node and one per pair of groups. Only where the flow through the nodes is wanted do nodes carry
their edges too, each pair of a list once and those across lists, so that it is that of the whole graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import cut, spread, stored
from tidemark.operators.intervals import whole_groups
from tidemark.llm.vectors import Cell, build_index, fit, scan_cells

#: Inflation exponent and smallest share kept.
INFLATION, PRUNE = 2.0, 1e-3
#: Largest entry less the sum of squares below which a column is settled, share by which equal entries may differ, and rounds after
#: which flow that is not settled is an error.
CHAOS, EQUAL, ROUNDS = 1e-3, 0.01, 100
#: Nodes of a component that is settled in one task, as a matrix of 32 MB.
COMPONENT_NODES = 2048
_DDL = "kind byte, a bigint, b bigint, w double, ids array<bigint>, near array<bigint>, sim array<float>"
_NODE, _LINK = 0, 1


def local_attractors(n: int, row: np.ndarray, col: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Attractor of each of n nodes: Markov clustering of a graph given by both directions of its edges, all of them.

    Flow stays in a connected component, so components are matrices of their own, those of one size a batch.
    """
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, row, label[col])
        low = low[low]
        if (low == label).all():
            break
        label = low
    order = np.argsort(label, kind="stable")
    _, first, size = np.unique(label[order], return_index=True, return_counts=True)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n) - np.repeat(first, size)
    number = np.empty(n, np.int64)
    number[order] = np.repeat(np.arange(len(size)), size)
    attractor = np.arange(n)
    by_size = np.argsort(size[number[row]], kind="stable")
    bounds = np.searchsorted(size[number[row]][by_size], np.arange(n + 2))
    for k in np.unique(size[size > 1]):
        which = np.nonzero(size == k)[0]
        mine = by_size[bounds[k] : bounds[k + 1]]
        place = np.searchsorted(which, number[row[mine]])
        step = max(1, (1 << 22) // int(k * k))
        for i in range(0, len(which), step):
            here = mine[(place >= i) & (place < i + step)]
            m = np.zeros((min(step, len(which) - i), k, k))
            m[np.searchsorted(which, number[row[here]]) - i, at[col[here]], at[row[here]]] = sim[here]
            m[:, np.arange(k), np.arange(k)] = m.max(axis=1)
            to = settle_columns(m / m.sum(axis=1, keepdims=True))
            nodes = order[first[which[i : i + step]][:, None] + np.arange(k)]
            attractor[nodes] = np.take_along_axis(nodes, to, 1)
    return attractor


def _groups(pairs: bool):
    def reduce(cell: Cell, row: np.ndarray, member: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        m = cell.members
        inner = row < m
        attractor = local_attractors(m, row[inner], member[inner], s[inner])
        group = cell.lead[attractor[member]] if m else np.zeros(0, np.int64)
        other = np.where(inner, cell.lead[attractor[np.where(inner, row, 0)]] if m else 0, cell.lead[row] if len(row) else 0)
        ends = np.stack([other, group], axis=1)[other != group]
        weight = s[other != group]
        pair, at = np.unique(ends, axis=0, return_inverse=True) if len(ends) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        weight = np.bincount(at.ravel(), weight, len(pair))
        # each pair of the list once, and those with members of other lists
        use = np.nonzero((~inner | (row < member)) & pairs)[0]
        use = use[np.argsort(member[use], kind="stable")]
        cuts = np.searchsorted(member[use], np.arange(1, m))
        none = np.zeros(0, np.int64)
        return pd.DataFrame({
            "kind": np.r_[np.full(m, _NODE), np.full(len(pair), _LINK)].astype(np.int8),
            "a": np.r_[cell.lead[:m], pair[:, 0]],
            "b": np.r_[cell.lead[attractor], pair[:, 1]],
            "w": np.r_[np.zeros(m), weight],
            "ids": [*cell.ids[:m], *[none] * len(pair)],
            "near": [*(np.split(cell.lead[row[use]], cuts) if m else []), *[none] * len(pair)],
            "sim": [*(np.split(s[use].astype(np.float32), cuts) if m else []), *[none.astype(np.float32)] * len(pair)],
        })

    return reduce


def through_flow(nodes: DataFrame) -> DataFrame:
    """(node, flow) of (node, near, sim), which hold each edge of the whole graph at one end or at both: the row sums of the squared flow matrix.

    Of M, with loops as strong as a node's strongest edge and columns of sum one, these are M (M 1), so two passes over the edges do.
    """
    half = nodes.select("node", F.explode(F.arrays_zip("near", "sim")).alias("e")).select(F.col("node").alias("a"), F.col("e.near").alias("b"), F.col("e.sim").alias("s"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).repartition("a")
    each = both.groupBy("a", "b").agg(F.max("s").alias("s")).groupBy("a").agg(F.collect_list(F.struct("b", "s")).alias("e"), F.max("s").cast("double").alias("loop"), F.sum(F.col("s").cast("double")).alias("sum"))
    each = cut(each.select(F.col("a").alias("node"), "e", "loop", (F.col("sum") + F.col("loop")).alias("sum")))

    def send(rows: DataFrame, x: Column) -> DataFrame:
        rows = rows.withColumn("x", x / F.col("sum"))
        loops = rows.select("node", (F.col("loop") * F.col("x")).alias("flow"))
        return loops.unionByName(rows.select("x", F.explode("e").alias("e")).select(F.col("e.b").alias("node"), (F.col("e.s") * F.col("x")).alias("flow"))).groupBy("node").agg(F.sum("flow").alias("flow"))

    flow = send(each.join(send(each, F.lit(1.0)), "node"), F.col("flow"))
    # sums in another order differ in the last digits only
    return nodes.select("node").join(flow, "node", "left").select("node", F.round(F.coalesce("flow", F.lit(1.0)), 9).alias("flow"))


def settle_columns(m: np.ndarray) -> np.ndarray:
    """Attractor of each node of a batch (k, n, n) of flow matrices with columns of sum one.

    Squares, inflates and prunes each matrix until its columns hold one entry, or a few of equal size.
    """
    out = np.zeros(m.shape[:2], np.int64)
    live = np.arange(len(m))
    for _ in range(ROUNDS):
        m = m @ m
        np.power(m, INFLATION, out=m)
        m /= m.sum(axis=1, keepdims=True)
        m[(m < PRUNE) & (m < m.max(axis=1, keepdims=True))] = 0
        m /= m.sum(axis=1, keepdims=True)
        done = (m.max(axis=1) - (m * m).sum(axis=1)).max(axis=1) < CHAOS
        if done.any():
            # argmax takes the first, so the smallest node, of the entries that are equal
            to = (m[done] >= m[done].max(axis=1, keepdims=True) * (1 - EQUAL)).argmax(axis=1)
            out[live[done]] = np.take_along_axis(to, to, 1)
            live, m = live[~done], m[~done]
        if not len(live):
            return out
    raise RuntimeError(f"flow still changes after {ROUNDS} rounds")


def _whole_component(f: pd.DataFrame) -> pd.DataFrame:
    """(node, cluster) of one component's edges (a, b, w)."""
    names, at = np.unique(f["a"].to_numpy(), return_inverse=True)
    m = np.zeros((len(names), len(names)))
    m[np.searchsorted(names, f["b"].to_numpy()), at] = f["w"].to_numpy()
    np.fill_diagonal(m, m.max(axis=0))
    return pd.DataFrame({"node": names, "cluster": names[settle_columns((m / m.sum(axis=0))[None])[0]]})


def coarse_flow(edges: DataFrame, component: DataFrame, dense: int = COMPONENT_NODES) -> DataFrame:
    """(node, cluster) of the Markov clustering of a weighted graph given as both directions (a, b, w) of its edges.

    Flow never leaves a connected component, of which ``component`` names (node, component): one of at most ``dense`` nodes is settled
    in one task, without a shuffle per round; only wider ones are a distributed matrix.
    """
    wide = component.groupBy("component").agg((F.count("*") > dense).alias("wide"))
    kind = component.join(wide, "component").withColumnRenamed("node", "a")
    edges = cut(edges.join(kind, "a"))
    near = edges.where("not wide").groupBy("component").applyInPandas(_whole_component, "node bigint, cluster bigint")
    far = edges.where("wide").select("a", "b", "w")
    return near if far.isEmpty() else near.unionByName(distributed_flow(far))


def distributed_flow(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, cluster) of the Markov clustering of a graph too wide for a task, until its columns are settled; raises if they never are.

    The matrix is kept as (i, j, v) with columns of sum one. A round joins it with itself on the inner
    index, sums, inflates, prunes and normalises; it is written to the shared folder, so no lineage grows.
    """
    column = Window.partitionBy("j")

    def settle(m: DataFrame, power: float) -> DataFrame:
        m = m.withColumn("v", F.pow("v", F.lit(power))).withColumn("v", F.col("v") / F.sum("v").over(column))
        m = m.withColumn("top", F.max("v").over(column)).where((F.col("v") >= PRUNE) | (F.col("v") == F.col("top")))
        return m.select("i", "j", (F.col("v") / F.sum("v").over(column)).cast("float").alias("v"))

    loops = edges.groupBy("a").agg(F.max("w").alias("w")).select(F.col("a").alias("i"), F.col("a").alias("j"), F.col("w").cast("float").alias("v"))
    m = cut(settle(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), F.col("w").cast("float").alias("v")).unionByName(loops).repartition("j"), 1.0))
    for _ in range(rounds):
        left, right = m.select("i", F.col("j").alias("k"), F.col("v").alias("x")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        product = left.join(right, "k").select("i", "j", (F.col("x") * F.col("y")).cast("float").alias("v")).repartition("j").groupBy("j", "i").agg(F.sum("v").alias("v"))
        m = cut(settle(product, INFLATION))
        # settled once each column holds one entry, or a few of equal size
        chaos = m.groupBy("j").agg((F.max("v") - F.sum(F.col("v") * F.col("v"))).alias("c")).agg(F.max("c")).first()[0]
        if chaos is None or chaos < CHAOS:
            break
    else:
        raise RuntimeError(f"flow still changes after {rounds} rounds")
    top = m.withColumn("top", F.max("v").over(column)).where(F.col("v") >= F.col("top") * (1 - EQUAL))
    to = top.groupBy("j").agg(F.min("i").alias("cluster")).withColumnRenamed("j", "node")
    up = to.select(F.col("node").alias("cluster"), F.col("cluster").alias("above"))
    return to.join(up, "cluster").select("node", F.col("above").alias("cluster"))


def _settled(f: pd.DataFrame) -> pd.DataFrame:
    """(node, to) of the edges (a, b, w) of whole parts of neighbourhoods: where the settled flow of each node goes, level by level until no edge within is left.

    What holds the neighbourhood's centre is named after it, as the centre is in all parts of its neighbourhood.
    """
    part = f.groupby(["a_home", "a_part"], sort=False).ngroup().to_numpy()
    both = np.concatenate([np.stack([part, f[c].to_numpy()], axis=1) for c in ("a", "b", "a_home")])
    names, at = np.unique(both, axis=0, return_inverse=True)
    row, col, home = np.split(at.ravel(), 3)
    w, to = f["w"].to_numpy(), np.arange(len(names))
    for _ in range(len(names)):
        next_ = local_attractors(len(names), row, col, w)
        to = next_[to]
        row, col = next_[row], next_[col]
        pair, at = np.unique(np.stack([row, col], axis=1)[row != col], axis=0, return_inverse=True)
        w = np.bincount(at.ravel(), w[row != col], len(pair))
        if not len(pair):
            break
        row, col = pair[:, 0], pair[:, 1]
    centre = np.arange(len(names))
    centre[to[home]] = home
    to = centre[to]
    moved = to != np.arange(len(names))
    return pd.DataFrame({"node": names[moved, 1], "to": names[to[moved], 1]})


def _neighbourhoods(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # no edge leads from one part to another, so those of a batch are one matrix of many components
    for f in whole_groups(frames, ["a_home", "a_part"]):
        yield _settled(f)


def flow_levels(edges: DataFrame, levels: int = 64, dense: int = COMPONENT_NODES) -> DataFrame:
    """(node, cluster) of both directions (a, b, w) of a graph's edges: flow level by level, until no edge leaves a cluster.

    At a level each node joins the neighbourhood of the node that ranks highest among itself and its neighbours, by the order of magnitude of its
    degree, then by a hash of this level. The edges inside a neighbourhood are a flow matrix of their own, settled in one task; one of more than ``dense`` nodes is cut by a hash, its
    centre is in all parts, and edges between parts wait for the next level. An expected share of the nodes goes in each level, so the levels
    grow with the logarithm of the graph, a hub is done in one.
    """
    label = None
    for level in range(levels):
        rank = edges.groupBy("a").agg(F.struct(F.floor(F.log2(F.count("*"))).alias("d"), F.xxhash64(F.col("a"), F.lit(level)).alias("h"), F.col("a").alias("n")).alias("r"))
        best = edges.join(rank.select(F.col("a").alias("b"), "r"), "b").groupBy("a").agg(F.max("r").alias("m")).join(rank, "a")
        home = best.select(F.col("a").alias("node"), F.greatest("m", "r")["n"].alias("home"))
        part = F.pmod(F.xxhash64("node"), F.ceil(F.count("*").over(Window.partitionBy("home")) / dense))
        home = stored(home.select("node", "home", part.alias("part")))
        at = lambda c: home.select(F.col("node").alias(c), F.col("home").alias(f"{c}_home"), F.col("part").alias(f"{c}_part"))
        inner = edges.join(at("a"), "a").join(at("b"), "b").where("a_home = b_home and (a_part = b_part or a = a_home or b = a_home)")
        inner = inner.withColumn("a_part", F.when(F.col("a") == F.col("a_home"), F.col("b_part")).otherwise(F.col("a_part")))
        moved = stored(inner.repartition("a_home", "a_part").sortWithinPartitions("a_home", "a_part").mapInPandas(_neighbourhoods, "node bigint, to bigint"))
        to = lambda c: moved.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        if label is None:
            label = home.select("node", F.col("node").alias("cluster"))
        label = label.join(to("cluster"), "cluster", "left").select("node", F.coalesce("cluster_to", "cluster").alias("cluster"))
        left = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"), "w").where("a <> b")
        edges = stored(left.groupBy("a", "b").agg(F.sum("w").alias("w")))
        if edges.isEmpty():
            return stored(label)
    raise RuntimeError(f"links still leave clusters after {levels} levels")


def similarity_clusters(vectors: DataFrame, vector_id: str, vector: str, threshold: float = 0.85, dim: int = 64, flow: bool = True) -> DataFrame:
    """(cluster, markov, id, flow): each valid vector's row; ``cluster`` numbers whatever chains of pairs join that are at least
    ``threshold`` similar, ``markov`` the Markov cluster of one level inside it, ``flow`` what passed through the vector (without ``flow`` both are null, which spares writing
    the edges).

    A vector like no other makes a cluster of its own. Vectors that are null, of another length than
    ``dim``, not finite or all zero, and rows without id, are left out; exact copies are one vector with
    several ids; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vector_id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    qz = fit(rows, dim)
    if qz is None:
        return spark.createDataFrame([], "cluster bigint, markov bigint, id bigint, flow double")
    shared = spark.sparkContext.broadcast(qz)
    index, hot = build_index(spread(rows, "id"), dim, shared)
    found = cut(scan_cells(index, dim, shared, threshold, _groups(flow), _DDL))
    nodes = found.where(F.col("kind") == _NODE).select(F.col("a").alias("node"), F.col("b").alias("local"), "ids", "near", "sim")
    links = found.where(F.col("kind") == _LINK).select(F.col("a").alias("node"), "b", "w")
    # a link leaves a node of another list or the name of a group, which is a node of it
    ends = links.join(nodes.select("node", "local"), "node").where("local <> b").select(F.least("local", "b").alias("a"), F.greatest("local", "b").alias("b"), "w")
    half = ends.groupBy("a", "b").agg(F.sum("w").alias("w"))
    turn = lambda e, *more: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))
    edges = cut(turn(half, "w"))
    if edges.isEmpty():
        top = spark.createDataFrame([], "local bigint, markov bigint, cluster bigint")
    else:
        top = flow_levels(edges).select(F.col("node").alias("local"), "cluster")
        if flow:
            markov = coarse_flow(edges, top.select(F.col("local").alias("node"), F.col("cluster").alias("component")))
            top = cut(markov.select(F.col("node").alias("local"), F.col("cluster").alias("markov")).join(top, "local"))
        else:
            top = top.withColumn("markov", F.lit(None).cast("bigint"))
    out = nodes.join(top, "local", "left")
    out = out.join(through_flow(nodes), "node") if flow else out.withColumn("flow", F.lit(None).cast("double"))
    local = F.col("local")
    out = out.select(F.coalesce("cluster", local).alias("cluster"), (F.coalesce("markov", local) if flow else F.lit(None).cast("bigint")).alias("markov"), F.explode("ids").alias("id"), "flow")
    if hot is None:
        return out
    # a hot vector's leader stands for all its copies
    led = out.join(F.broadcast(hot.leads.withColumnRenamed("lead", "id")), "id", "left_semi").withColumnRenamed("id", "lead")
    more = hot.copies.where("id <> lead").join(F.broadcast(led), "lead").select("cluster", "markov", "id", "flow")
    return out.unionByName(more)


def name_clusters(members: DataFrame) -> DataFrame:
    """(cluster_id, face_id) of clusters of two or more; cluster_id is the smallest id."""
    size = members.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.max("id").alias("last")).where("last > cluster_id").drop("last")
    return members.select("cluster", "id").join(size, "cluster").select("cluster_id", F.col("id").alias("face_id")).distinct()


def describe_clusters(members: DataFrame, key: str = "cluster", typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical_ids): of each cluster of two or more, its ``typical`` members of the strongest flow, then smaller ids."""
    members = members.groupBy(key, "id").agg(F.max("flow").alias("flow"))
    w = Window.partitionBy(key).orderBy(F.desc("flow"), "id")
    best = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    best = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("typical_ids"))
    size = members.groupBy(key).agg(F.min("id").alias("cluster_id"), F.count("*").alias("size")).where("size >= 2")
    return size.join(best, key).select("cluster_id", "size", "typical_ids")
