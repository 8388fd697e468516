import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.operators import cells as C
from lumenarc.operators import density as D
from lumenarc.operators import search as S


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")


def dealt(spark, x, **k):
    return C.Cells(frame(spark, x).select("id", F.col("embedding").alias("v")), **k)


def blobs(seed=42, n=60, centres=((0, 0), (12, 0), (0, 12)), spread=1.0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n, len(c))) * spread + np.array(c) for c in centres])


def mutual(x, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(samples, len(x) - 1)]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def kruskal(m):
    """Tree edges by (weight, a, b)."""
    n, top, out = len(m), list(range(len(m))), []

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for w, a, b in sorted((m[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        i, j = root(a), root(b)
        if i != j:
            top[i] = j
            out.append((w, a, b))
    return out


def plain_labels(edges, n, size):
    """Condensed tree and excess of mass by walking one dendrogram, top down."""
    members, node_of, made = {i: [i] for i in range(n)}, list(range(n)), {}
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (w, a, b) in enumerate(edges):
        i, j, new = root(a), root(b), n + k
        top += [new]
        top[i] = top[j] = new
        made[new] = (w, i, j)
        members[new] = members[i] + members[j]
    clusters = {}

    def walk(node, cluster, born):
        """Rows leave `cluster` below node."""
        stack = [node]
        while stack:
            node = stack.pop()
            if node not in made:
                clusters[cluster]["left"].append((node, np.inf))
                continue
            w, i, j = made[node]
            density = 1 / max(w, D.TINY)
            big = [c for c in (i, j) if len(members[c]) >= size]
            if len(big) == 2:
                for c in big:
                    clusters[c] = {"born": density, "parent": cluster, "left": []}
                    clusters[cluster]["kids"] = [*clusters[cluster].get("kids", []), c]
                    walk(c, c, density)
                continue
            for c in (i, j):
                if c in big:
                    stack.append(c)
                else:
                    clusters[cluster]["left"] += [(m, density) for m in members[c]]

    clusters[n + len(edges) - 1] = {"born": 0.0, "parent": None, "left": []}
    walk(n + len(edges) - 1, n + len(edges) - 1, 0.0)
    order = sorted(clusters, reverse=True)
    total, pick, best = {}, {}, {}
    for c in reversed(order):
        held, kids = clusters[c], clusters[c].get("kids", [])
        total[c] = len(held["left"]) + sum(total[k] for k in kids)
        own = sum(d - held["born"] for _, d in held["left"]) + sum(total[k] * (clusters[k]["born"] - held["born"]) for k in kids)
        below = sum(best[k] for k in kids)
        pick[c] = held["parent"] is not None and (not kids or own >= below)
        best[c] = max(own, below) if kids else own
    label = [-1] * n

    def name(c, chosen):
        chosen = chosen if chosen is not None else c if pick[c] else None
        for m, _ in clusters[c]["left"]:
            label[m] = chosen if chosen is not None else -1
        for k in clusters[c].get("kids", []):
            name(k, chosen)

    name(order[0], None)
    first = {}
    for i, c in enumerate(label):
        if c != -1:
            first.setdefault(c, i)
    return [first[c] if c != -1 else -1 for c in label]


@pytest.mark.parametrize("n_cells", [1, 9])
def test_nearest_others_equal_brute_force(spark, n_cells):
    x = np.random.default_rng(0).normal(size=(80, 3))
    got = {}
    for r in C.nearest_others(dealt(spark, x, cells=n_cells), 4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], round(r["distance"], 9)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i][:4]
        assert sorted(got[i]) == [(k + 1, j, round(d[i, j], 9)) for k, j in enumerate(order)]


def test_parts_of_cells_and_of_queries_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_ROWS", 7)
    monkeypatch.setattr(C, "PART_QUERIES", 5)
    x = np.random.default_rng(1).normal(size=(60, 2))
    got = {(r["id"], r["other"]) for r in C.nearest_others(dealt(spark, x, cells=3), 2).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag([np.inf] * len(x))
    assert got == {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:2]}


def test_similar_pairs_equal_all_pairs_and_leave_cells_out(spark):
    x = blobs(n=30, centres=((9, 0, 0), (0, 9, 0), (0, 0, 9), (-9, 0, 0)), spread=0.6)
    df = frame(spark, x)
    cells = C.Cells(C.unit_rows(df, "id"), cells=8)
    got = {(r["src"], r["dst"]): r["score"] for r in C.similar_pairs(cells, 0.97).collect()}
    want = {(r["src"], r["dst"]): r["score"] for r in S.neighbours(df, "id", None, least=0.97).collect()}
    assert got == want and want
    assert cells.visited_share(C.within(cells, 0.97)) < 0.5
    none = frame(spark, np.zeros((3, 2)))
    assert C.similar_pairs(C.Cells(C.unit_rows(none, "id")), 0.5).count() == 0


@pytest.mark.parametrize("listed", [3, 8])
def test_spanning_tree_equals_kruskal(spark, listed):
    x = np.round(blobs(seed=3, n=25), 2)
    cells = dealt(spark, x, cells=6)
    near = D.staged(spark, C.nearest_others(cells, listed), "near")
    tree = D.spanning_tree(cells, near, D.core_distances(near, 3)).collect()
    want = kruskal(mutual(x, 3))
    assert len(tree) == len(x) - 1
    assert np.allclose(sorted(r["w"] for r in tree), [w for w, _, _ in want])
    top = list(range(len(x)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in tree:
        assert root(r["a"]) != root(r["b"])
        top[root(r["a"])] = root(r["b"])


def test_labels_equal_one_dendrogram(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([blobs(seed=5, n=20, centres=((0, 0), (4, 0), (0, 9), (30, 30))), rng.uniform(-20, 40, size=(20, 2))])
    edges = kruskal(mutual(x, 3))
    tree = spark.createDataFrame([(a, b, float(w)) for w, a, b in edges], "a long, b long, w double")
    got = {r["id"]: r["label"] for r in D.hierarchy_labels(tree, spark.range(len(x)).select("id"), 5).collect()}
    want = plain_labels(edges, len(x), 5)
    assert [got[i] for i in range(len(x))] == want
    assert len(set(want)) > 3 and -1 in want


def test_finder_equals_walking_up():
    rng = np.random.default_rng(4)
    splits, left = [], list(range(12))
    groups = {i: i for i in left}
    for k in range(11):
        a, b = (int(v) for v in rng.choice(left, 2, replace=False))
        splits.append(((float(k // 3), k, k + 1), groups[a], groups[b]))
        left.remove(b)
    tree = D.Hierarchy(list(range(12)), splits)
    find = tree.finder()
    for leaf in range(12):
        for e in [(float(w), a, 0) for w in range(5) for a in range(12)]:
            c = leaf
            while tree.parent[c] >= 0 and tree.edge[tree.parent[c]] < e:
                c = tree.parent[c]
            assert find(np.array([leaf]), [e])[0] == c


def test_two_groups_and_scattered_rows(spark):
    rng = np.random.RandomState(42)
    two = np.vstack([rng.randn(15, 2) + 5, rng.randn(15, 2) - 5])
    got = {r["id"]: r["label"] for r in D.hdbscan(frame(spark, two), "id").collect()}
    assert len(got) == 30 and len(set(got.values()) - {-1}) >= 2
    assert not {got[i] for i in range(15)} & {got[i] for i in range(15, 30)} - {-1}
    scattered = np.random.RandomState(42).randn(10, 2) * 100
    assert -1 in {r["label"] for r in D.hdbscan(frame(spark, scattered), "id").collect()}


def test_few_equal_and_missing_rows(spark):
    assert {r["label"] for r in D.hdbscan(frame(spark, np.zeros((3, 2))), "id").collect()} == {-1}
    assert D.hdbscan(frame(spark, np.zeros((3, 2))).limit(0), "id").count() == 0
    same = np.concatenate([np.zeros((8, 2)), np.ones((8, 2))])
    labels = {r["id"]: r["label"] for r in D.hdbscan(frame(spark, same), "id").collect()}
    assert {labels[i] for i in range(8)} == {0} and {labels[i] for i in range(8, 16)} == {8}
