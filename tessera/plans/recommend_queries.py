"""Registered recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import recommend as N
from tessera.operators.splitting import SplitConfig, split_assign
from tessera.operators.topk import top_items
from tessera.plans.prep_queries import _alloc_sql
from tessera.plans.registry import register, rounded, table
from tessera.session import cut_lineage

INTER_SQL = ("(SELECT o_custkey AS \"user\", l_partkey AS item, sum(l_quantity) AS weight "
             "FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)")

SPLIT_SQL = f"""e AS (SELECT "user", item, weight, '' AS cls,
       sha256('42' || chr(0) || CAST("user" AS VARCHAR) || chr(1) || CAST(item AS VARCHAR)) AS pr,
       CAST("user" AS VARCHAR) || chr(1) || CAST(item AS VARCHAR) AS tk FROM {INTER_SQL} i),
{_alloc_sql("SELECT cls, count(*) AS n FROM e GROUP BY cls", (0.8, 0.2, 0.0))},
r AS (SELECT e.*, row_number() OVER (ORDER BY pr, tk) - 1 AS rk FROM e),
s AS (SELECT "user", item, weight, CASE WHEN rk < c0 THEN 'train' WHEN rk < c0 + c1 THEN 'validation'
             ELSE 'test' END AS split FROM r JOIN alloc USING (cls)),
tr AS (SELECT * FROM s WHERE split = 'train'), va AS (SELECT * FROM s WHERE split = 'validation')"""


def split_interactions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    # the derived pair table feeds three passes of the split: ``interactions`` has written it
    inter = N.interactions(joined, "o_custkey", "l_partkey", "l_quantity")
    s = split_assign(inter, SplitConfig("random", 0.8, 0.2, 0.0), ["user", "item"])
    # the split pairs feed ALS iterations, ranks and several counts: materialise them once
    s = cut_lineage(s)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "validation")


@register("G33_interactions", f"SELECT \"user\", item, round(weight, 6) AS weight FROM {INTER_SQL} i")
def q_inter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    out = N.interactions(li.join(o, li.l_orderkey == o.o_orderkey), "o_custkey", "l_partkey", "l_quantity")
    return rounded(out, {"weight": 6})


@register("G34_popularity", f"""WITH {SPLIT_SQL}
SELECT item, round(sum(weight), 6) AS popularity,
       row_number() OVER (ORDER BY sum(weight) DESC, item) - 1 AS grank FROM tr GROUP BY item""")
def q_pop(spark, d):
    train, _ = split_interactions(spark, d)
    return rounded(N.popularity(train).select("item", "popularity", "grank"), {"popularity": 6})


@register("J04_unseen_candidates", f"""WITH {SPLIT_SQL}
SELECT va."user", va.item FROM va WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr."user" = va."user" AND tr.item = va.item)""")
def q_unseen(spark, d):
    train, val = split_interactions(spark, d)
    return val.select("user", "item").join(train.select("user", "item"), ["user", "item"], "left_anti")


@register("N04_popularity_recall_at_10", f"""WITH {SPLIT_SQL},
items AS (SELECT DISTINCT item FROM tr), users AS (SELECT DISTINCT "user" FROM tr),
nitems AS (SELECT count(*) AS n FROM items),
pop AS (SELECT item, row_number() OVER (ORDER BY sum(weight) DESC, item) - 1 AS grank FROM tr GROUP BY item),
rel AS (SELECT DISTINCT "user", item FROM va WHERE "user" IN (SELECT * FROM users) AND item IN (SELECT * FROM items)),
seen AS (SELECT DISTINCT "user", item FROM tr),
ev AS (SELECT r."user", count(*) AS rel_n, least(10, (SELECT n FROM nitems)) AS kk,
              (SELECT n FROM nitems) - (SELECT count(*) FROM seen WHERE seen."user" = r."user") AS avail
       FROM rel r GROUP BY r."user"),
ev2 AS (SELECT "user", rel_n, least(kk, avail) AS cnt FROM ev WHERE least(kk, avail) > 0),
hit AS (SELECT r."user", p.grank - (SELECT count(*) FROM seen s JOIN pop ps USING (item)
                                    WHERE s."user" = r."user" AND ps.grank < p.grank) AS unseen_rank
        FROM rel r JOIN pop p USING (item))
SELECT round(avg(coalesce(h, 0) / rel_n), 10) AS recall_at_10, count(*) AS evaluated_users FROM ev2
LEFT JOIN (SELECT h."user", count(*) AS h FROM hit h JOIN ev2 USING ("user") WHERE unseen_rank < cnt GROUP BY 1) x
USING ("user")""")
def q_pop_recall(spark, d):
    train, val = split_interactions(spark, d)
    return rounded(N.popularity_recall(train, val), {"recall_at_10": 10})


@register("N05_cold_start_counts", f"""WITH {SPLIT_SQL}
SELECT (SELECT count(*) FROM va WHERE "user" NOT IN (SELECT "user" FROM tr)) AS cold_user_rows,
       (SELECT count(*) FROM va WHERE "user" IN (SELECT "user" FROM tr) AND item NOT IN (SELECT item FROM tr))
       AS cold_item_rows""")
def q_cold(spark, d):
    train, val = split_interactions(spark, d)
    return N.cold_start(train, val)


@register("N03_recall_at_10")
def q_als_recall(spark, d):
    """N01 + N03: implicit ALS fitted on the training pairs, recall@10 on held-out pairs."""
    train, val = split_interactions(spark, d)
    model, ui, ii = N.fit_als(train, factors=8, iterations=5)
    return N.als_recall(train, val, model, ui, ii)


@register("N02_svd_recall_at_10")
def q_svd_recall(spark, d):
    """N02 + N03: truncated-SVD factors of the training pairs, recall@10 on held-out pairs."""
    train, val = split_interactions(spark, d)
    ui = N.index_ids(train, "user", "uid")
    ii = N.index_ids(train, "item", "iid")
    users, items, _ = N.truncated_svd(train, factors=8, ui=ui, ii=ii)
    return N.als_recall(train, val, N.factor_model(users, items, ui, ii), ui, ii)


@register("N06_recommend_top_k")
def q_recommend(spark, d):
    train, val = split_interactions(spark, d)
    model, ui, ii = N.fit_als(train, factors=8, iterations=5)
    users = val.select("user").distinct()
    return N.recommend(model, ui, ii, train, users, k=5)


VECTOR_TOP_SQL = """
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (
  SELECT u.vec_id AS "user", i.vec_id AS item, list_inner_product(u.x, i.x) AS score,
    row_number() OVER (PARTITION BY u.vec_id ORDER BY list_inner_product(u.x, i.x) DESC) AS rank
  FROM p u JOIN p i ON u.label <> i.label)
SELECT "user", item, round(score, 9) AS score, rank FROM s WHERE rank <= 5"""


@register("N06_top_inner_products", VECTOR_TOP_SQL)
def q_top_inner_products(spark, d):
    """Each vector's five best of another label: the exact search of N03 and N06 on factors that the tables hold."""
    vectors = table(spark, d, "embeddings").withColumn("x", F.col("embedding"))
    top, _ = top_items(vectors.select(F.col("vec_id").alias("user"), "x", "label"), vectors.select(F.col("vec_id").alias("item"), "x", "label"),
                       5, first=64, block=48, apart="label")
    return rounded(top, {"score": 9})
