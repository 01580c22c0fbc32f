"""Recommendation.

Evaluation protocol: held-out (user, item) pairs; a validation user counts when it is known in
training and has at least one held-out item known in training; training-seen items are excluded
from its ranking; k = min(10, training items).  Rank of a relevant item among the user's unseen
items = its global rank - (seen items ranked above it), which the distributed rank core computes
per user over (rank, seen-flag) rows -- no per-user pair expansion, hot users are range-split.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_finite
from tessera.functions.ranking import cumulative
from tessera.operators.topk import top_items
from tessera.session import cut_lineage, release


def interactions(df: DataFrame, user: str, item: str, weight: str | None = None) -> DataFrame:
    """Duplicates merged -- weights summed, or distinct pairs with weight 1.  Rows without a user
    or item, and weights that are not positive finite numbers, are an error that gives their counts."""
    no_id = F.col(user).isNull() | F.col(item).isNull()
    odd = ~F.coalesce(is_finite(weight) & (F.col(weight) > 0), F.lit(False)) if weight else F.lit(False)
    w = F.sum(F.when(~odd, F.col(weight).cast("double"))) if weight else F.lit(1.0)
    merged = df.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(
        F.count_if(no_id | odd).alias("_bad"), *([w.alias("weight")] if weight else []))
    merged = cut_lineage(merged)  # the rows are read once: they are merged and checked in one pass
    if not merged.where(F.col("_bad") > 0).isEmpty():
        bad = df.agg(F.count_if(no_id).alias("ids"), F.count_if(odd).alias("weights")).first()
        raise ValueError(f"{bad['ids']} rows lack {user} or {item}, {bad['weights']} have no positive finite {weight}")
    return merged.select("user", "item", "weight" if weight else w.alias("weight"))


def popularity(train: DataFrame) -> DataFrame:
    """Item popularity = sum of training weights; ``grank`` = 0-based rank by popularity
    desc then item asc (the stable tie order), from the distributed rank core."""
    pop = train.groupBy("item").agg(F.sum("weight").alias("popularity"))
    ranked = cumulative(pop.withColumn("_one", F.lit(1)), [], [F.col("popularity").desc(), F.col("item").asc()],
                        weight="_one", before="grank", total="n_items")
    return ranked.drop("_one")


def cold_start(train: DataFrame, val: DataFrame) -> DataFrame:
    """Validation rows whose user / item does not occur in training (anti joins)."""
    users = train.select("user").distinct()
    items = train.select("item").distinct()
    cu = val.join(users, "user", "left_anti").count()
    ci = val.join(users, "user", "left_semi").join(items, "item", "left_anti").count()
    return val.sparkSession.createDataFrame([(cu, ci)], "cold_user_rows long, cold_item_rows long")


def recall_from_ranks(train: DataFrame, val: DataFrame, item_rank: DataFrame, k: int = 10,
                      per_user_rank: bool = False, unseen: bool = False) -> DataFrame:
    """Mean recall@k given item ranks (``grank`` per item, or per (user, item) when
    ``per_user_rank``; ``unseen``: those ranks are of unseen items only).  Returns recall_at_k and evaluated users."""
    n_items = train.select("item").distinct().count()
    kk = min(k, n_items)
    users = train.select("user").distinct()
    items = train.select("item").distinct()
    relevant = cut_lineage(
        val.join(users, "user", "left_semi").join(items, "item", "left_semi").select("user", "item").distinct())
    seen = train.select("user", "item").distinct()
    keys = ["user", "item"] if per_user_rank else ["item"]
    seen_n = seen.groupBy("user").agg(F.count(F.lit(1)).alias("_seen_n"))
    rel_n = relevant.groupBy("user").agg(F.count(F.lit(1)).alias("_rel_n"))
    evaluated = cut_lineage(
        rel_n.join(seen_n, "user", "left").fillna(0, ["_seen_n"])
        .withColumn("_count", F.least(F.lit(kk), F.lit(n_items) - F.col("_seen_n"))).where(F.col("_count") > 0))
    # a held-out item the user already saw is relevant but excluded from the ranking: always a
    # miss (it stays in the denominator); only unseen relevant items can be hits.
    # Items without a rank (outside a scored list) cannot precede ranked ones: they are misses
    if unseen:
        ranked = relevant.join(item_rank.select(*keys, "grank"), keys).withColumn("_seen_before", F.lit(0))
    else:
        # no more than ``_seen_n`` items of a rank are seen: one at or beyond ``_count + _seen_n`` is no hit and precedes none
        reach = evaluated.select("user", (F.col("_count") + F.col("_seen_n")).alias("_reach"))
        most = reach.agg(F.max("_reach")).first()[0] or 0
        ahead = item_rank.where(F.col("grank") < F.lit(most)).select(*keys, "grank")

        def near(pairs):
            return pairs.join(ahead, keys).join(reach, "user").where(F.col("grank") < F.col("_reach")) \
                .select("user", "item", "grank")

        passed = cut_lineage(near(train.select("user", "item")).distinct())
        rows = near(relevant).join(passed, ["user", "item"], "left_anti").withColumn("_seen", F.lit(0)).unionByName(
            passed.withColumn("_seen", F.lit(1)))
        ranked = cumulative(rows, ["user"], ["grank"], weight="_seen", before="_seen_before", total="_seen_listed") \
            .where(F.col("_seen") == 0)
    hits = ranked.join(evaluated, "user") \
        .where(F.col("grank") - F.col("_seen_before") < F.col("_count")) \
        .groupBy("user").agg(F.count(F.lit(1)).alias("_hits"))
    per_user = evaluated.join(hits, "user", "left").select(
        "user", (F.coalesce("_hits", F.lit(0)) / F.col("_rel_n")).alias("recall"))
    return per_user.agg(F.avg("recall").alias(f"recall_at_{k}"), F.count(F.lit(1)).alias("evaluated_users"))


def popularity_recall(train: DataFrame, val: DataFrame, k: int = 10) -> DataFrame:
    """Popularity baseline recall@k under the same protocol."""
    return recall_from_ranks(train, val, popularity(train), k)


def index_ids(values: DataFrame, col: str, name: str) -> DataFrame:
    """Dense 0-based integer ids in value order (ALS needs int ids), distributed."""
    d = values.select(col).distinct().withColumn("_one", F.lit(1))
    found = cut_lineage(cumulative(d, [], [col], weight="_one", before=name, total="_n").select(col, name))
    n = found.agg(F.max(name)).first()[0]
    if n is not None and n >= 2**31 - 1:
        raise ValueError(f"{n + 1} values of {col}: ALS takes fewer than 2^31")
    return found.select(col, F.col(name).cast("int"))


def fit_als(train: DataFrame, factors: int = 8, iterations: int = 10, regularization: float = 0.01,
            seed: int = 42):
    """Implicit-feedback ALS on indexed ids; returns (model, user index, item index)."""
    ui = index_ids(train, "user", "uid")
    ii = index_ids(train, "item", "iid")
    data = train.join(ui, "user").join(ii, "item")
    als = ALS(rank=factors, maxIter=iterations, regParam=regularization, implicitPrefs=True, userCol="uid",
              itemCol="iid", ratingCol="weight", seed=seed, coldStartStrategy="nan")
    return als.fit(data), ui, ii


#: most ids and, on average, pairs of a block, which a task holds; most ids of a slice and pairs of a tile, which a row holds
BLOCK_IDS, BLOCK_PAIRS, SLICE_IDS, TILE_PAIRS = 1 << 19, 1 << 23, 1 << 13, 1 << 16
#: passes after which the item factors are written
WRITE_EVERY = 5


def _layout(n: int, pairs: int, cores: int) -> tuple[int, int, int]:
    """(blocks, slices of a block, ids of a slice) for ``n`` dense ids: enough blocks for every core."""
    blocks = max(-(-n // BLOCK_IDS), -(-pairs // BLOCK_PAIRS), min(cores, -(-n // 256)))
    blocks = -(-blocks // cores) * cores if blocks > cores else blocks
    width = -(-n // blocks)
    slices = -(-width // SLICE_IDS)
    return blocks, slices, -(-width // slices)


def _tiles(pairs: DataFrame, by: str, on: str, by_layout: tuple[int, int, int], on_layout: tuple[int, int, int]) -> DataFrame:
    """``pairs`` (uid, iid, weight) as rows of ``TILE_PAIRS`` at most, each of one block of ``by`` and one slice of ``on``;
    a block is a partition, so that its products with a factor table need no exchange."""
    import numpy as np
    import pandas as pd
    blocks, slices, ids = by_layout
    block = F.col(by) / F.lit(slices * ids)
    laid = pairs.select(F.floor(block).cast("int").alias("block"), F.floor(F.col(on) / F.lit(on_layout[2])).cast("int").alias("slice"),
                        F.pmod(F.col(by), F.lit(slices * ids)).alias("row"), F.pmod(F.col(on), F.lit(on_layout[2])).alias("col"),
                        F.col("weight"))
    laid = laid.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "slice", "row")

    def pack(batches):
        held, size = [], 0

        def rows(df):
            ends = np.flatnonzero(np.diff(df["slice"].to_numpy()) | np.diff(df["block"].to_numpy())) + 1
            for lo, hi in zip([0, *ends], [*ends, len(df)]):
                for at in range(lo, hi, TILE_PAIRS):
                    part = df.iloc[at:min(at + TILE_PAIRS, hi)]
                    yield (part["block"].iat[0], part["slice"].iat[0], part["row"].to_numpy("<i4").tobytes(),
                           part["col"].to_numpy("<i4").tobytes(), part["weight"].to_numpy("<f8").tobytes())

        def out(found):
            return pd.DataFrame(found, columns=["block", "slice", "rows", "cols", "weights"])

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= 4 * TILE_PAIRS:  # the last tile may go on in the next batch
                *found, _ = rows(df := pd.concat(held, ignore_index=True))
                if found:
                    yield out(found)
                rest = sum(len(f[2]) // 4 for f in found)
                held, size = [df.iloc[rest:]], len(df) - rest
        if size:
            yield out(list(rows(pd.concat(held, ignore_index=True))))

    return laid.mapInPandas(pack, "block int, slice int, rows binary, cols binary, weights binary")


def _times(tiles: DataFrame, factors: DataFrame, m, layout: tuple[int, int, int]) -> DataFrame:
    """Sparse matrix times ``factors @ m``: (slice, data) rows of the blocks of ``layout``.

    Every task holds the tiles of one block and its sums, and reads all slices of the factor table, one after another:
    nothing is exchanged, and no sum leaves its task before it is whole."""
    import numpy as np
    import pandas as pd
    _, slices, ids = layout
    r, k = m.shape

    def run(batches):
        block, total, last, x = None, None, None, None

        def out():
            return pd.DataFrame({"slice": np.arange(block * slices, (block + 1) * slices, dtype=np.int32),
                                 "data": [total[i * ids:(i + 1) * ids].tobytes() for i in range(slices)]})

        for b in batches:
            for own, at, data, rows, cols, weights in b.itertuples(index=False):
                if own != block:  # a partition holds one block
                    if block is not None:
                        raise ValueError(f"blocks {block} and {own} in one partition")
                    block, total = own, np.zeros((slices * ids, k))
                if at != last:
                    last, x = at, np.frombuffer(data, "<f8").reshape(-1, r) @ m
                rows = np.frombuffer(rows, "<i4")  # rising
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                terms = x[np.frombuffer(cols, "<i4")] * np.frombuffer(weights, "<f8")[:, None]
                total[rows[starts]] += np.add.reduceat(terms, starts, axis=0)
        if block is not None:
            yield out()

    # a nested loop over partitions: one stream of all factors against the tiles of each block, which stay where they are
    met = factors.coalesce(1).join(tiles.hint("shuffle_replicate_nl"), "slice")
    return met.select("block", "slice", "data", "rows", "cols", "weights").mapInPandas(run, "slice int, data binary")


def _gram(factors: DataFrame, r: int):
    """``X^T X`` (r x r) of a factor table: each task adds up its slices (numpy), Spark sums the per-task matrices
    element-wise, and only the r*r sums reach the driver."""
    import numpy as np
    import pandas as pd

    def partial(batches):
        g = np.zeros((r, r))
        for b in batches:
            for data in b["data"]:
                x = np.frombuffer(data, "<f8").reshape(-1, r)
                g += x.T @ x
        yield pd.DataFrame({"g": [g.ravel()]})

    parts = factors.select("data").mapInPandas(partial, "g array<double>")
    sums = parts.select(F.posexplode("g").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).collect()
    g = np.zeros(r * r)
    for row in sums:  # r * r rows
        g[row["pos"]] = row["v"]
    return g.reshape(r, r)


def _orthonormal(factors: DataFrame, r: int):
    """The matrix that takes a factor table to an orthonormal basis of its column space: E diag(lambda)^-1/2 from the
    eigen-decomposition of the Gram matrix (directions with no weight are dropped)."""
    import numpy as np
    lam, e = np.linalg.eigh(_gram(factors, r))
    keep = lam > max(lam.max(), 0.0) * 1e-12
    if not keep.any():
        raise ValueError("the interaction matrix has no weight")
    return e[:, keep] / np.sqrt(lam[keep])


def _sliced(values: DataFrame, id: str, cols: list[str], layout: tuple[int, int, int]) -> DataFrame:
    """Rows of ``cols`` by dense ``id`` as a factor table."""
    import numpy as np
    import pandas as pd
    blocks, slices, ids = layout
    rows = values.select(F.floor(F.col(id) / F.lit(slices * ids)).cast("int").alias("_block"), id, *cols) \
        .repartitionById(blocks, F.col("_block")).sortWithinPartitions(id)

    def pack(batches):
        at, x = None, None
        for b in batches:
            slice_of = b[id].to_numpy() // ids
            for s in np.unique(slice_of):
                if s != at:
                    if at is not None:
                        yield pd.DataFrame({"slice": [at], "data": [x.tobytes()]})
                    at, x = s, np.zeros((ids, len(cols)))
                own = slice_of == s
                x[b[id].to_numpy()[own] % ids] = b.loc[own, cols].to_numpy(float)
        if at is not None:
            yield pd.DataFrame({"slice": [at], "data": [x.tobytes()]})

    return rows.mapInPandas(pack, "slice int, data binary")


def _unsliced(factors: DataFrame, m, key: str, id: str, index: DataFrame, layout: tuple[int, int, int]) -> DataFrame:
    """``factors @ m`` as rows (key, f0, f1, ...)."""
    import numpy as np
    import pandas as pd
    ids = layout[2]
    names = [f"f{j}" for j in range(m.shape[1])]

    def unpack(batches):
        for b in batches:
            for at, data in zip(b["slice"], b["data"]):
                x = np.frombuffer(data, "<f8").reshape(-1, m.shape[0]) @ m
                out = pd.DataFrame(x, columns=names)
                out.insert(0, id, np.arange(at * ids, at * ids + len(x), dtype=np.int64))
                yield out

    rows = factors.mapInPandas(unpack, f"{id} long, " + ", ".join(f"{c} double" for c in names))
    return rows.join(index.select(key, id), id).select(key, *names)


def truncated_svd(train: DataFrame, factors: int, iterations: int = 20, oversample: int | None = None,
                  seed: int = 42, ui: DataFrame | None = None, ii: DataFrame | None = None):
    """The ``factors`` largest singular triplets of the user x item weight matrix by block
    subspace iteration (randomised range finder with power iterations, V <- orth(A^T A V)).

    The pairs are laid out twice, by blocks of users and by blocks of items, and stay on the executors' disks.  Every
    pass is two sparse products, in which a task reads the factors that its block meets, and one orthonormalisation whose
    only driver-side object is an r x r Gram matrix (r = factors + oversample, default 2 x factors).  A pass exchanges
    nothing: its factors are kept by the executors, and written to the checkpoint folder after every ``WRITE_EVERY`` passes,
    so lineage stays that long.  ``ui`` and ``ii`` are the ``index_ids`` of the users and items, if the caller has them; pairs without a user or
    item count for nothing.  Returns (user factors = U * s, item factors = V, singular values), the factor tables holding
    ``f0 .. f{k-1}``."""
    import numpy as np
    from pyspark import StorageLevel
    from tessera.functions.columns import hash_unit, priority
    a = train.select("user", "item", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")) \
        .where(F.col("user").isNotNull() & F.col("item").isNotNull())
    spark = a.sparkSession
    ui = index_ids(a, "user", "uid") if ui is None else ui
    ii = index_ids(a, "item", "iid") if ii is None else ii
    n_users, n_items = ui.count(), ii.count()
    if not 1 <= factors < min(n_users, n_items):
        raise ValueError(f"{factors} factors do not fit {n_users} users x {n_items} items: 1 or more, fewer than either")
    r = min(factors + (factors if oversample is None else oversample), n_users, n_items)
    cols = [f"c{j}" for j in range(r)]
    pairs = cut_lineage(a.join(ui, "user").join(ii, "item").select("uid", "iid", "weight"))
    n, cores = pairs.count(), spark.sparkContext.defaultParallelism
    by_user, by_item = _layout(n_users, n, cores), _layout(n_items, n, cores)
    user_tiles = _tiles(pairs, "uid", "iid", by_user, by_item).persist(StorageLevel.DISK_ONLY)
    item_tiles = _tiles(pairs, "iid", "uid", by_item, by_user).persist(StorageLevel.DISK_ONLY)
    # deterministic start block: a hash of (seed, item, column), centred on 0
    z = cut_lineage(_sliced(ii.select("iid", *[
        (hash_unit(priority(seed, F.concat_ws("#", F.col("item").cast("string"), F.lit(str(j))))) - 0.5).alias(c)
        for j, c in enumerate(cols)]), "iid", cols, by_item))
    m, written, passes = np.eye(r), z, max(1, iterations)
    for step in range(1, passes + 1):
        y = _times(user_tiles, z, m, by_user).persist(StorageLevel.MEMORY_AND_DISK)  # A V
        before, z = z, _times(item_tiles, y, np.eye(m.shape[1]), by_item)  # A^T A V
        keep = step % WRITE_EVERY > 0 and step < passes
        z = z.persist(StorageLevel.MEMORY_AND_DISK) if keep else cut_lineage(z)
        m = _orthonormal(z, m.shape[1])  # V = Z M; a kept Z is computed here
        y.unpersist()
        if before is not written:
            before.unpersist()
        if not keep:  # what was written before is no longer needed to compute anything lost
            release(written)
            written = z
    q = cut_lineage(_times(user_tiles, z, m, by_user))
    release(z)
    mq = _orthonormal(q, m.shape[1])  # Q = A V M'
    b = cut_lineage(_times(item_tiles, q, mq, by_item))  # B^T = A^T Q
    user_tiles.unpersist()
    item_tiles.unpersist()
    release(pairs)
    lam, w = np.linalg.eigh(_gram(b, mq.shape[1]))  # B B^T = W S^2 W^T
    order = np.argsort(-lam)[:factors]
    sig = np.sqrt(np.clip(lam[order], 0.0, None))
    w = w[:, order]
    inv = np.where(sig > 0, 1.0 / np.where(sig > 0, sig, 1.0), 0.0)
    users = _unsliced(q, mq @ (w * sig), "user", "uid", ui, by_user)  # U S = Q W S
    items_f = _unsliced(b, w * inv, "item", "iid", ii, by_item)  # V = B^T W S^-1
    return users, items_f, [float(x) for x in sig]


def factor_model(user_factors: DataFrame, item_factors: DataFrame, ui: DataFrame, ii: DataFrame):
    """An MLlib ``ALSModel`` over given factor tables (``f0 ..`` columns); ids are the dense indices of ``index_ids``."""
    from pyspark.ml.recommendation import ALSModel
    fcols = sorted((c for c in user_factors.columns if c.startswith("f")), key=lambda c: int(c[1:]))
    arr = F.array(*[F.col(c).cast("float") for c in fcols])
    uf = user_factors.join(ui, "user").select(F.col("uid").alias("id"), arr.alias("features"))
    itf = item_factors.join(ii, "item").select(F.col("iid").alias("id"), arr.alias("features"))
    spark = user_factors.sparkSession
    jm = spark._jvm.org.apache.spark.ml.recommendation.ALSModel("svd", len(fcols), uf._jdf, itf._jdf)
    return ALSModel(jm.setUserCol("uid").setItemCol("iid").setPredictionCol("prediction"))


def ranked_unseen(model, ui: DataFrame, ii: DataFrame, train: DataFrame, users: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """(user, item, score, rank) of each known user's k best unseen items, exactly, and what it took (``topk.top_items``)."""
    known = users.select("user").distinct().join(ui, "user")
    asked = known.join(model.userFactors.withColumnRenamed("id", "uid"), "uid").select("user", F.col("features").alias("x"))
    offered = ii.join(model.itemFactors.withColumnRenamed("id", "iid"), "iid").select("item", F.col("features").alias("x"))
    return top_items(asked, offered, k, train.join(known.select("user"), "user", "left_semi").select("user", "item"))


def als_recall(train: DataFrame, val: DataFrame, model, ui: DataFrame, ii: DataFrame, k: int = 10) -> DataFrame:
    """recall@k of model scores (ALS, or the SVD factors via ``factor_model``), from each evaluated user's exact top k
    unseen items."""
    users = val.join(train.select("user").distinct(), "user", "left_semi").select("user")
    top, _ = ranked_unseen(model, ui, ii, train, users, k)
    return recall_from_ranks(train, val, top.select("user", "item", (F.col("rank") - 1).alias("grank")), k, per_user_rank=True,
                             unseen=True)


def recommend(model, ui: DataFrame, ii: DataFrame, train: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Top-k unseen items for the given users; unknown users get the popularity top-k
    (seen items are not removed there, as nothing is known about them)."""
    best, _ = ranked_unseen(model, ui, ii, train, users, k)
    best = best.withColumn("fallback", F.lit(False))
    unknown = users.join(ui, "user", "left_anti")
    top_pop = popularity(train).where(F.col("grank") < k).collect()  # k rows
    if not top_pop:
        return best
    entries = F.array(*[F.struct(F.lit(r["item"]).alias("item"), F.lit(float(r["popularity"])).alias("score"),
                                 F.lit(int(r["grank"]) + 1).cast("bigint").alias("rank")) for r in top_pop])
    fb = unknown.select("user", F.inline(entries)).withColumn("fallback", F.lit(True))
    return best.unionByName(fb)
