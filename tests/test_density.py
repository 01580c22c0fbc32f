"""DBSCAN (X03) against brute force, connected components, and stored assignments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.components import connected_components
from tessera.operators import density
from tessera.operators.assignments import SourceChanged, open_assignments, store_assignments
from tessera.session import checkpoint_dir


def brute(x, eps, least):
    """Labels in order of the first core row; a border row belongs to the first cluster that reaches it."""
    d2 = sum(np.square(x[:, None, k] - x[None, :, k]) for k in range(x.shape[1]))
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.full(len(x), -1)
    for c, start in enumerate(i for i in range(len(x)) if core[i]):
        if label[start] >= 0:
            continue
        label[start], open_ = c, [start]
        while open_:
            j = open_.pop()
            if core[j]:
                new = np.flatnonzero(near[j] & (label < 0))
                label[new] = c
                open_ += new.tolist()
    kept = sorted(set(label[label >= 0].tolist()))
    return [kept.index(v) if v >= 0 else -1 for v in label], core.tolist()


def clusters(spark, x, eps, least, **how):
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "k long, x array<double>, pid int")
    got = sorted(map(tuple, density.dbscan(df, "k", "x", eps, least, **how).collect()))
    label, core = brute(np.asarray(x, float), eps, least)
    assert got == list(zip(range(len(x)), label, core, strict=True))
    return label


def test_dense_third_repeats_and_noise(spark):
    """One small dense region, one point a hundred times, and a sparse rest, cut into many zones."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(0, 10, (400, 2)), rng.normal(5, .05, (300, 2)), np.repeat([[1., 1.]], 100, 0)])
    assert len(set(clusters(spark, x, .5, 6, zone=50, leaf=8))) > 3


def test_chain_across_zones_and_ties_at_eps(spark):
    """A chain that many zones hold parts of, and a lattice whose neighbours lie at eps exactly."""
    grid = np.array([(i / 4, j / 4) for i in range(14) for j in range(14) if (i * j) % 3])
    clusters(spark, grid, .25, 4, zone=20, leaf=4)
    chain = np.stack([np.linspace(0, 4, 200)] * 3, 1)
    assert set(clusters(spark, chain, .2, 3, zone=15)) == {0}


def test_wide_points_meet_by_matrix_products(spark, monkeypatch):
    """Wide points overlap all boxes: they are not measured pair by pair, and pairs at eps exactly are still decided as measured."""
    rng = np.random.default_rng(4)
    sites = rng.normal(0, 1, (9, 16))
    x = np.concatenate([sites[rng.integers(0, 9, 500)] + rng.normal(0, .25, (500, 16)), rng.normal(0, 1, (60, 16)), np.repeat(sites[:1], 7, 0)])
    assert len(set(clusters(spark, x, 1.2, 5, zone=90, leaf=16))) > 3
    lattice = np.array([[i // 2 ** k % 2 / 4 for k in range(9)] + [1e3] * 3 for i in range(512)])[rng.permutation(512)[:300]]
    clusters(spark, lattice, .25, 4, zone=70)
    measured = density._points2(x, x)
    assert (density._within(x, x, float(measured[3, 9])) == (measured <= measured[3, 9])).all()

    def pairwise(a, b):
        raise AssertionError("measured pair by pair")
    monkeypatch.setattr(density, "_points2", pairwise)
    root = density._joined(x, 1.44)
    assert len(set(root.tolist())) < len(x) and density._within(x, x, 1.44).any()


def test_odd_tables(spark):
    clusters(spark, [[1., 2.]], .1, 2)
    assert set(clusters(spark, [[0., -0.]] * 7, .1, 7)) == {0}
    none = spark.createDataFrame([], "k long, x array<double>")
    assert density.dbscan(none, "k", "x", 1.).collect() == []
    for bad in ([None], [[1., None]], [[1., float("nan")]], [[1.], [1., 2.]], [[]]):
        with pytest.raises(ValueError):
            density.dbscan(spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "k long, x array<double>"), "k", "x", 1.)
    with pytest.raises(ValueError):
        density.dbscan(none, "k", "x", 0.)


def test_zone_links_decide_by_boxes():
    rng = np.random.default_rng(2)
    lo = rng.uniform(0, 5, (60, 2))
    boxes = np.arange(60), lo, lo + rng.uniform(0, .3, (60, 2))
    links, asked = density.zone_links(boxes, 1.)
    near = density._nearest2(boxes[1], boxes[2], boxes[1], boxes[2]) <= 1.
    far = density._farthest2(boxes[1], boxes[2], boxes[1], boxes[2])
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert near[a, b]
        root[find(a)] = find(b)
    for a in range(60):
        for b in range(a):  # whole links may be left out only where others join the two
            if far[a, b] <= 1.:
                assert find(a) == find(b)
            elif near[a, b]:
                assert find(a) == find(b) or (a, b) in asked or (b, a) in asked or far[a, b] <= 1.


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 600)] + [(5, 5)]
    nodes = sorted({n for e in edges for n in e} | {999})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["root"] for r in got.collect()} == root


def test_stored_assignments(spark):
    source = spark.createDataFrame([(i, [i / 10]) for i in range(50)], "k long, x array<double>")
    path = checkpoint_dir(spark).rstrip("/") + "/assigned_test"
    assigned = source.select("k", (F.col("k") % 3).alias("cluster"))
    store_assignments(assigned, "k", source, path, {"eps": 1}, buckets=8)
    stored = open_assignments(spark, path, source.repartition(7))
    assert stored.about == {"eps": 1} and stored.buckets == 8
    asked = spark.createDataFrame([(7, "a"), (7, "b"), (400, "c"), (None, "d")], "k long, n string")
    found = stored.lookup(asked)
    assert sorted((r["n"], r["cluster"], r["status"]) for r in found.collect()) == [
        ("a", 1, "assigned"), ("b", 1, "assigned"), ("c", None, "unknown_row"), ("d", None, "unknown_row")]
    plan = stored.lookup(asked)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("SelectedBucketsCount: 8 out of 8")[0].rsplit("FileScan", 1)
    assert plan.count("Exchange ") == 1  # the asked rows'; the stored side is read, filtered and merged
    assert "Exchange" not in above[above.rindex("+- "):] and "Exchange" not in below
    assert stored.row(spark, 9) == {"k": 9, "cluster": 0} and stored.row(spark, 900) is None
    with pytest.raises(SourceChanged):
        open_assignments(spark, path, source.where("k > 0"))
    with pytest.raises(ValueError):
        stored.lookup(asked.withColumn("cluster", F.lit(1)))
    for bad in (assigned.union(assigned), assigned.limit(4), assigned.withColumn("k", F.lit(None).cast("long"))):
        with pytest.raises(ValueError):
            store_assignments(bad, "k", source, path + "_bad")


def test_dense_boxes_are_linked_by_one_step(monkeypatch):
    rng = np.random.default_rng(5)
    for x, eps in ((rng.random((1_500, 2)) * 0.7, 1.0), (rng.random((700, 2)), 0.03), (rng.random((700, 2)), 0.2)):
        rows = [{"pid": own, "x": x[own].ravel()} for own in density._leaves(x, 50)]
        boxes = density._Boxes(rows, 2)
        steps = []
        plain = density._Union.join
        monkeypatch.setattr(density._Union, "join", lambda self, i, j, plain=plain: (steps.append(1), plain(self, i, j)))
        root = density._linked(boxes, eps * eps)
        monkeypatch.setattr(density._Union, "join", plain)
        want = np.arange(len(x))
        near = density._points2(boxes.x, boxes.x) <= eps * eps
        while True:
            least = np.where(near, want[None, :], len(x)).min(axis=1)
            if (least == want).all():
                break
            want = least
        assert (root == want).all()
        if eps == 1.0:
            assert len(steps) <= len(x) + len(rows) ** 2
