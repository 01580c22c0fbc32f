"""Exact top-k by norm buckets against scoring every pair."""

import numpy as np

from tessera.operators.topk import top_items


def brute(users, items, k, seen):
    order = sorted(items, key=lambda i: (-np.sqrt(sum(v * v for v in items[i])), i))
    out = []
    for u, x in users.items():
        scored = sorted(((-float(np.dot(x, items[i])), p, i) for p, i in enumerate(order) if (u, i) not in seen))[:k]
        out += [(u, i, round(-s, 9), r) for r, (s, _, i) in enumerate(scored, 1)]
    return sorted(out)


def search(spark, users, items, k, seen, **how):
    tables = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in t.items()], f"{n} long, x array<double>")
              for n, t in (("user", users), ("item", items))]
    pairs = spark.createDataFrame(list(seen), "user long, item long")
    got, met = top_items(*tables, k, pairs, **how)
    return sorted((r["user"], r["item"], round(r["score"], 9), r["rank"]) for r in got.collect()), met


def test_equals_full_scoring_and_stops_early(spark):
    rng = np.random.default_rng(1)
    items = {i: rng.normal(size=6) * 20 / (1 + i % 300) for i in range(600)}
    items |= {700 + i: items[3] for i in range(4)}  # equal items
    users = {u: rng.normal(size=6) for u in range(40)} | {50: np.zeros(6)}
    seen = {(u, int(i)) for u in users for i in rng.choice(600, 30)} | {(7, i) for i in items} | {(8, i) for i in items if i > 2}
    got, met = search(spark, users, items, 5, seen, first=16, block=24)
    assert got == brute(users, items, 5, seen)
    assert met["users"] == 41 and met["pairs"] < 0.7 * 41 * len(items)


def test_odd_sizes(spark):
    items = {1: [1., 2.], 2: [0., 0.], 3: [-1., 5.]}
    for users, k in (({1: [1., 1.]}, 10), ({}, 3), ({1: [1., 1.]}, 0)):
        assert search(spark, users, items, k, {(1, 3)})[0] == brute(users, items, k, {(1, 3)})
    assert search(spark, {1: [1.]}, {}, 3, set())[0] == []


def test_own_group_is_passed_over_without_pairs(spark):
    """Items of the user's group count as seen: as with all their pairs named, but none is made.  Null is no group."""
    rng = np.random.default_rng(2)
    items = {i: rng.normal(size=12) for i in range(500)}
    of = {i: None if i % 50 == 7 else "abc"[i % 3] for i in items}
    table = spark.createDataFrame([(i, [float(v) for v in x], of[i]) for i, x in items.items()], "item long, x array<double>, g string")
    got, _ = top_items(table.withColumnRenamed("item", "user"), table, 5, apart="g", first=64, block=48)
    seen = {(u, i) for u in items for i in items if of[u] is not None and of[u] == of[i]}
    assert sorted((r["user"], r["item"], round(r["score"], 9), r["rank"]) for r in got.collect()) == brute(items, items, 5, seen)


def test_no_more_than_k_rows_of_a_user_leave_a_task():
    """However many places a user has seen, and however many blocks it meets."""
    import pyarrow as pa

    from tessera.operators import topk
    rng = np.random.default_rng(3)
    y = rng.normal(size=(900, 4))
    y = y[np.argsort(-np.linalg.norm(y, axis=1))]
    x = rng.normal(size=(30, 4))
    seen = [sorted(rng.choice(900, 200, replace=False).tolist()) for _ in x]

    class Held:
        value = y, np.linalg.norm(y, axis=1), None

    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(list(x)), pa.array(np.linalg.norm(x, axis=1)), pa.array([-np.inf] * 30),
                                        pa.array(seen, pa.list_(pa.int64())), pa.nulls(30)], names=["user", "x", "own", "floor", "places", "of"])
    got = pa.Table.from_batches(topk._scorer(Held, 0, 3, 100)([batch])).to_pylist()
    assert len(got) == 90
    for u in range(30):
        want = [p for p in np.argsort(-(y @ x[u]), kind="stable") if p not in set(seen[u])][:3]
        assert [r["pos"] for r in got if r["user"] == u] == want
