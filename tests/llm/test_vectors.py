import dataclasses

import numpy as np
import pytest

from tidemark.llm import vectors as V
from tidemark.llm.clusters import coarse_flow, describe_clusters, flow_levels, local_attractors, name_clusters, similarity_clusters
from tidemark.llm.vectors import nearest_vectors

DDL = "id bigint, embedding array<float>, lead string, list int"


def looks(n_looks=60, per=6, dim=64, seed=5):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n_looks, dim)), per, axis=0)
    x += rng.normal(size=x.shape) * rng.choice([0.15, 0.3, 0.45], size=(len(x), 1))
    return x.astype(np.float32)


def table(spark, x, extra=()):
    rows = [(i + 1, [float(a) for a in v], "clash", 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), DDL).repartition(3)


BAD = [(9001, None, "", 0), (9002, [1.0] * 63, "", 0), (9003, [float("nan")] + [1.0] * 63, "", 0), (9004, [0.0] * 64, "", 0), (9005, [float("inf")] * 64, "", 0), (9006, [None] + [1.0] * 63, "", 0), (None, [1.0] * 64, "", 0), (9007, [], "", 0)]


def brute(x, q=None):
    u = V.unit(x)
    s = np.round((u if q is None else V.unit(q)) @ u.T, 6)
    out = {}
    for i, row in enumerate(s):
        order = [j for j in np.lexsort((np.arange(len(x)), -row)) if row[j] >= 0.85 and (q is not None or j != i)]
        out[i + 1] = [int(j) + 1 for j in order[:5]]
    return out


def found(df, query=False):
    got = {}
    for r in df.where(f"query = {str(query).lower()}").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    return got


def test_small_set_is_exact_with_copies_and_ties(spark):
    x = looks()
    x = np.concatenate([x, np.repeat(x[:1], 9, axis=0), x[5:6] * 2])
    q = x[::7] + np.float32(0.01)
    want = brute(x)
    df = nearest_vectors(table(spark, x, BAD), table(spark, q).withColumnRenamed("embedding", "e"), "id", "embedding", "id", "e").cache()
    got = found(df)
    assert all(got.get(i, []) == w for i, w in want.items()), [(i, got.get(i), w) for i, w in want.items() if got.get(i, []) != w][:3]
    assert set(got) <= set(want)
    assert all(found(df, True).get(i, []) == w for i, w in brute(x, q).items())


def test_repeated_rows_count_once(spark):
    x = looks(5)
    t = table(spark, x)
    got = found(nearest_vectors(t.unionByName(t), None, "id", "embedding"))
    assert got == {i: w for i, w in brute(x).items() if w}


def test_recall_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(V, "LIST_ROWS", 60)
    x = looks(500, 6)
    want = {(i, j) for i, w in brute(x).items() for j in w}
    got = {(i, j) for i, w in found(nearest_vectors(table(spark, x), None, "id", "embedding")).items() for j in w}
    assert len(got & want) / len(want) > 0.95


def test_a_sample_too_large_for_the_driver_is_fitted_by_the_executors(spark, monkeypatch):
    monkeypatch.setattr(V, "LIST_ROWS", 60)
    monkeypatch.setattr(V, "DRIVER_SAMPLE", 100)
    x = np.concatenate([looks(300, 6), np.repeat(looks(1, 1), 50, axis=0)])
    want = {(i, j) for i, w in brute(x).items() for j in w}
    got = {(i, j) for i, w in found(nearest_vectors(table(spark, x, BAD), None, "id", "embedding")).items() for j in w}
    assert len(got & want) / len(want) > 0.95


def test_estimates_never_lose_a_pair():
    x = looks(80)
    qz = V._train(np.array([v.tobytes() for v in x], object), 64, 4, len(x), 1)
    u = V.unit(x)
    at = np.zeros(len(x), int)
    codes, err = qz.encode(u.astype(np.float32), at)
    cell = V.Cell(np.arange(len(x)), np.zeros(len(x)), [np.array([i]) for i in range(len(x))], u, len(x))
    pairs = {(a, b) for r, m, _ in V.similar_pairs(cell, codes, err, qz, 0, 0.85) for a, b in zip(r, m)}
    s = np.round(u @ u.T, 6)
    assert pairs == {(a, b) for a, b in zip(*np.nonzero(s >= 0.85)) if a != b}


@pytest.mark.parametrize("rows", [[], BAD])
def test_nothing_valid(spark, rows):
    t = spark.createDataFrame(rows, DDL)
    assert nearest_vectors(t, None, "id", "embedding").count() == 0
    assert similarity_clusters(t, "id", "embedding").count() == 0


def components(x):
    s = np.round(V.unit(x) @ V.unit(x).T, 6) >= 0.85
    label = np.arange(len(x))
    while True:
        new = np.array([label[s[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    n = np.bincount(label, minlength=len(x))
    return {(label[i] + 1, i + 1) for i in range(len(x)) if n[label[i]] > 1}


def test_clusters_are_chains_of_pairs(spark):
    x = looks(60, 5)
    # a long chain: each link is similar to the next only
    a = np.zeros((40, 64), np.float32)
    t = np.arange(40) * 0.45
    a[:, 0], a[:, 1] = np.cos(t * (t < 6)), np.sin(t * (t < 6))
    x = np.concatenate([x, a, x[:1], x[3:4] * 3])
    df = similarity_clusters(table(spark, x, BAD), "id", "embedding").cache()
    got = {(r.cluster_id, r.face_id) for r in name_clusters(df).collect()}
    assert got == components(x)
    about = {r.cluster_id: r for r in describe_clusters(df).collect()}
    for c in {c for c, _ in got}:
        members = {f for k, f in got if k == c}
        assert about[c].size == len(members) and set(about[c].typical_ids) <= members
    # Markov clusters lie within these
    inside = df.groupBy("markov").agg({"cluster": "min", "*": "count"}).count()
    assert inside >= len({c for c, _ in got})


@pytest.mark.parametrize("dense", [2048, 8])
def test_levels_of_flow_end_with_whole_chains(spark, dense):
    """A long chain, a pair, a hub with many leaves and two cliques held by one weak edge; neighbourhoods cut into small parts give the same."""
    e = [(i, i + 1, 1.0) for i in range(60)] + [(100, 101, 0.9)] + [(200, 201 + i, 0.86) for i in range(90)]
    e += [(c + i, c + j, 0.99) for c in (400, 410) for i in range(6) for j in range(i)] + [(402, 413, 0.85)]
    df = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "a bigint, b bigint, w double")
    got = dict(tuple(r) for r in flow_levels(df, dense=dense).select("node", "cluster").collect())
    groups = {}
    for n, c in got.items():
        groups.setdefault(c, set()).add(n)
    want = [set(range(61)), {100, 101}, set(range(200, 291)), {*range(400, 406), *range(410, 416)}]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def settled(n, rounds=100):
    """Markov clusters of a chain of n nodes, each linked to the next by 1, by plain numpy until nothing changes."""
    m = np.eye(n) + np.eye(n, k=1) + np.eye(n, k=-1)
    m /= m.sum(axis=0)
    for _ in range(rounds):
        m = (m @ m) ** 2
        m /= m.sum(axis=0)
        m[(m < 1e-3) & (m < m.max(axis=0))] = 0
        m /= m.sum(axis=0)
        if (m.max(axis=0) - (m * m).sum(axis=0)).max() < 1e-3:
            to = (m >= m.max(axis=0) * 0.99).argmax(axis=0)
            return len(set(to[to]))


@pytest.mark.parametrize("n, dense", [(30, 2048), (11, 10)])
def test_coarse_flow_runs_until_columns_settle(spark, n, dense):
    e = [(i, i + 1, 1.0) for i in range(n - 1)] + [(100, 101, 1.0)]
    df = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "a bigint, b bigint, w double")
    component = spark.createDataFrame([(i, 0) for i in range(n)] + [(100, 100), (101, 100)], "node bigint, component bigint")
    got = dict(tuple(r) for r in coarse_flow(df, component, dense).select("node", "cluster").collect())
    assert set(got) == {*range(n), 100, 101} and got[100] == got[101]
    assert len({got[i] for i in range(n)}) == settled(n) <= n // 3


def test_flow_is_that_of_the_whole_graph(spark, monkeypatch):
    monkeypatch.setattr(V, "LIST_ROWS", 30)  # a cluster of 40 near-equal vectors lies in several lists
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((40, 64)) + rng.normal(size=(40, 64)) * 0.25, looks(20, 4)]).astype(np.float32)
    u = V.unit(x)
    m = np.round(u @ u.T, 6)
    m[m < 0.85] = 0
    np.fill_diagonal(m, 0)
    lone = m.max(axis=0) == 0
    np.fill_diagonal(m, np.where(lone, 1, m.max(axis=0)))
    m /= m.sum(axis=0)
    want = (m @ m).sum(axis=1)
    got = {r.id: r.flow for r in similarity_clusters(table(spark, x), "id", "embedding").collect()}
    assert np.allclose([got[i + 1] for i in range(len(x))], want, atol=1e-5)


def test_dense_lists_keep_all_edges():
    # two cliques of 12 equal edges, one weak link: every node has more edges than a narrow column would keep
    s = np.kron(np.eye(2), np.full((12, 12), 0.9))
    s[0, 12] = s[12, 0] = 0.85
    np.fill_diagonal(s, 0)
    row, col = np.nonzero(s)
    assert set(local_attractors(24, row, col, s[row, col])[:12]) != set(local_attractors(24, row, col, s[row, col])[12:])
    assert len(set(local_attractors(24, row, col, s[row, col]))) == 2


@pytest.mark.parametrize("k", [2, 9])
def test_a_visitor_brings_as_many_copies_as_k_needs(k):
    import pyarrow as pa

    x = looks(40)
    qz = V._train(np.array([v.tobytes() for v in x], object), 64, 4, len(x), 1)
    monkey = type("Shared", (), {"value": dataclasses.replace(qz, blocks=np.full_like(qz.blocks, 2))})  # two blocks: every vector visits one
    same = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([[float(a) for a in x[0]]] * 20, pa.list_(pa.float32()))], names=["id", "v"])
    rows = pa.Table.from_batches(V._route(monkey, 64, False, True, k + 1, False)(iter([same]))).to_pylist()
    assert {len(r["ids"]) for r in rows if r["role"] == V.VISITOR} == {k}


def test_hot_vectors_are_searched_once_and_all_copies_answered(spark, monkeypatch):
    """A third of all rows are one vector, another recurs too; few copies count as hot here, on the driver and on the executors."""
    x = looks(40, 4)
    x = np.concatenate([x, np.repeat(x[:1], 80, axis=0), np.repeat(x[77:78], 20, axis=0)])
    want, clusters = brute(x), name_clusters(similarity_clusters(table(spark, x), "id", "embedding")).collect()
    t = table(spark, x, BAD)
    for sample in (V.DRIVER_SAMPLE, 10):
        monkeypatch.setattr(V, "HOT_ROWS", 15)
        monkeypatch.setattr(V, "DRIVER_SAMPLE", sample)
        qz = V.fit(t.select("id", "embedding"), 64)
        assert len(qz.hot) == 2
        got = found(nearest_vectors(t.unionByName(t), None, "id", "embedding"))
        assert {i: got.get(i, []) for i in want} == want
        assert sorted(map(tuple, name_clusters(similarity_clusters(t, "id", "embedding")).collect())) == sorted(map(tuple, clusters))


def test_lists_of_a_vector_are_found_over_groups_in_flat_memory():
    """Two levels: the same lists as by all centroids, but for a few; what is held does not grow with the number of lists."""
    import tracemalloc

    rng = np.random.default_rng(1)
    peaks = []
    for n in (10_000, 130_000):
        c = V.unit(rng.normal(size=(n, 64))).astype(np.float32)
        g = round(n**0.5)
        centres = c[:g]
        home = V._nearest(c, centres)
        o = np.argsort(home, kind="stable")
        size = np.bincount(home, minlength=g)
        qz = V.Quantiser(c[o], np.zeros((16, 256, 4), np.float32), np.ones(n, np.int32), centres[size > 0], np.r_[0, np.cumsum(size[size > 0])])
        x = V.unit(c[rng.integers(0, n, 3000)] + rng.normal(size=(3000, 64)) * 0.06).astype(np.float32)
        tracemalloc.start()
        at, _ = qz.nearest(x, 12, 0.07)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        exact = V._nearest(x, qz.centroids)
        assert (at[:, 0] == exact).mean() > 0.95
    assert peaks[1] < 1.5 * peaks[0] < 150e6
