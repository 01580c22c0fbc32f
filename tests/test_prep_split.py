import pytest
from pyspark.sql import functions as F

from tessera.operators import transforms as X
from tessera.operators.sampling import filter_ranges, parse_ranges, priority_sample
from tessera.operators.splitting import SplitConfig, allocate, check_splits, split_assign, with_allocation
from tessera.plans.prepare import TaskConfig, prepare_task
from tessera.plans.recipe import Recipe


def _seats(n, shares):
    """Largest remainder written out: fill whole quotas, deal the rest by remainder, then feed empty splits."""
    import math
    active = [i for i in range(3) if shares[i] > 0]
    seats = {i: math.floor(n * shares[i]) for i in active}
    by_remainder = sorted(active, key=lambda i: (seats[i] - n * shares[i], i))
    for i in by_remainder[:n - sum(seats.values())]:
        seats[i] += 1
    for i in active:
        if not seats[i]:
            rich = max((j for j in active if seats[j] > 1), key=lambda j: (seats[j] - n * shares[j], -j))
            seats[rich] -= 1
            seats[i] = 1
    return [seats.get(i, 0) for i in range(3)]


@pytest.mark.parametrize("shares", [(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (0.8, 0.2, 0.0), (0.98, 0.01, 0.01),
                                    (0.01, 0.98, 0.01), (1.0, 0.0, 0.0)])
def test_allocation(spark, shares):
    totals = spark.range(3, 160).withColumnRenamed("id", "total")
    got = {r["total"]: [r["n_0"], r["n_1"], r["n_2"]] for r in with_allocation(totals, shares).collect()}
    assert got == {n: _seats(n, shares) for n in range(3, 160)}


def test_allocation_needs_enough_rows(spark):
    assert allocate(spark, 120, (0.7, 0.15, 0.15)) == [84, 18, 18]
    with pytest.raises(ValueError):
        allocate(spark, 2, (0.7, 0.15, 0.15))


def test_every_strategy_refuses_an_empty_split(spark):
    one = spark.createDataFrame([(i, "g", 1, "a" if i else "b") for i in range(20)], "row_id long, g string, t long, y string")
    for cfg in (SplitConfig("group", group_column="g"), SplitConfig("chronological", time_column="t")):
        with pytest.raises(ValueError):
            split_assign(one, cfg, "row_id")
    with pytest.raises(ValueError):  # class b has one row for three splits
        split_assign(one, SplitConfig("stratified"), "row_id", target="y")
    with pytest.raises(ValueError):
        split_assign(one.limit(2), SplitConfig("random"), "row_id")


def test_check_splits_counts_once(spark):
    rows = [(i, "train" if i < 6 else "validation" if i < 8 else "test", "ab"[i % 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, split string, y string")
    assert check_splits(df, SplitConfig(), "y") == {"train": 6, "validation": 2, "test": 2, "excluded": 0}
    with pytest.raises(ValueError):  # class c is never trained
        check_splits(df.withColumn("y", F.when(F.col("row_id") == 9, "c").otherwise(F.col("y"))), SplitConfig(), "y")
    with pytest.raises(ValueError):
        check_splits(df.where("split != 'test'"), SplitConfig(), "y")


def base(spark):
    return spark.createDataFrame([(i, float(i), i % 3, i // 3) for i in range(120)], "row_id long, x double, y long, g long")


def test_random_split_exact_and_partition_invariant(spark):
    df = base(spark)
    ref = None
    for parts in (1, 3, 7):
        out = split_assign(df.repartition(parts), SplitConfig("random"), "row_id")
        counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert counts == {"train": 84, "validation": 18, "test": 18}
        got = sorted((r["row_id"], r["split"]) for r in out.collect())
        ref = ref or got
        assert got == ref


def test_stratified_every_class_everywhere(spark):
    out = split_assign(base(spark), SplitConfig("stratified"), "row_id", target="y")
    per = out.groupBy("split").agg(F.countDistinct("y").alias("k")).collect()
    assert all(r["k"] == 3 for r in per)


def test_group_split_isolation(spark):
    out = split_assign(base(spark), SplitConfig("group", group_column="g"), "row_id")
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_chronological_ties_together(spark):
    df = base(spark).withColumn("t", F.col("g"))
    out = split_assign(df, SplitConfig("chronological", time_column="t"), "row_id")
    bounds = {r["split"]: (r["lo"], r["hi"]) for r in out.groupBy("split").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert bounds["train"][1] < bounds["validation"][0] <= bounds["validation"][1] < bounds["test"][0]


def test_missing_target_excluded(spark):
    df = spark.createDataFrame([(i, None if i == 0 else float(i % 2)) for i in range(40)], "row_id long, y double")
    out = split_assign(df, SplitConfig("random", 0.8, 0.2, 0.0), "row_id", target="y")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts["excluded"] == 1 and "test" not in counts


def test_leakage_mean_fitted_on_train_only(spark):
    df = spark.createDataFrame([(i, None if i == 5 else 1.0, i % 2) for i in range(100)], "row_id long, x double, y long")
    cfg = SplitConfig("random")
    assigned = split_assign(df, cfg, "row_id")
    train_ids = {r["row_id"] for r in assigned.where("split = 'train'").collect()}
    df2 = df.withColumn("x", F.when(F.col("row_id").isin(list(train_ids)) | (F.col("row_id") == 5), F.col("x"))
                        .otherwise(F.lit(99999.0)))
    r = Recipe()
    r.add("fill_missing", columns=["x"], strategy="mean")
    prepared = prepare_task(df2, TaskConfig("y"), cfg, r.approve_all(), key="row_id")
    assert prepared.fitted.states[0]["fills"]["x"] == 1.0


def test_row_drop_keeps_target_aligned(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i), float(i)) for i in range(90)],
                               "row_id long, x double, y double")
    r = Recipe()
    r.add("drop_missing", columns=["x"])
    prepared = prepare_task(df, TaskConfig("y", "regression"), SplitConfig("random"), r.approve_all(), key="row_id")
    out = prepared.frame.collect()
    assert all(row["y"] == row["row_id"] for row in out) and len(out) == 90 - 13


def test_find_replace_substring(spark):
    df = spark.createDataFrame([(" cat ", 1), ("dog", 2), (None, 3)], "a string, b long")
    out = X.FindReplace(["a"], "cat", "fox", "substring").apply(df)
    assert [r["a"] for r in out.orderBy("b").collect()] == [" fox ", "dog", None]


def test_mode_ties_by_text(spark):
    df = spark.createDataFrame([(10,), (2,), (10,), (2,), (None,)], "v long")
    step = X.FillMissing(["v"], "mode")
    assert step.fit(df)["fills"]["v"] == 10  # '10' < '2' as text


def test_convert_int_coerce(spark):
    df = spark.createDataFrame([("3.0",), ("2.5",), ("x",), (None,)], "s string")
    out = X.ConvertType(["s"], "Int64", errors="coerce").apply(df)
    assert [r["s"] for r in out.collect()] == [3, None, None, None]
    with pytest.raises(ValueError):
        X.ConvertType(["s"], "Int64").apply(df)


def test_row_ranges():
    assert parse_ranges("1, 3-1000000000") == [(1, 1), (3, 1000000000)]
    for bad in ("3-1", "x", "-1", "0"):
        with pytest.raises(ValueError):
            parse_ranges(bad)


def test_range_filter(spark):
    df = spark.createDataFrame([(i, f"{i:03d}") for i in range(1, 7)], "n long, ident string")
    out = filter_ranges(df, F.col("n"), "2-5", "3")
    assert sorted(r["ident"] for r in out.collect()) == ["002", "004", "005"]


def test_priority_sample_partition_free(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r["k"] for r in priority_sample(df.repartition(1), 50, 7, ["k"]).collect())
    b = sorted(r["k"] for r in priority_sample(df.repartition(5), 50, 7, ["k"]).collect())
    assert a == b and len(a) == 50


def test_priority_sample_breaks_key_ties_by_value(spark):
    from tessera.operators.sampling import per_group_sample, priority_sample
    rows = [(k % 7, "g", float(v)) for k in range(40) for v in (k, -k)]  # every key held by many rows
    df = spark.createDataFrame(rows, "k long, grp string, x double")
    one = priority_sample(df.repartition(1), 5, 42, ["k"]).collect()
    many = priority_sample(df.repartition(6, "x"), 5, 42, ["k"]).collect()
    assert sorted(one) == sorted(many)
    g1 = per_group_sample(df.repartition(1), "grp", 5, 42, ["k"]).collect()
    g6 = per_group_sample(df.repartition(6, "x"), "grp", 5, 42, ["k"]).collect()
    assert sorted(g1) == sorted(g6)


def test_execute_recipe_versions_and_sidecar(spark):
    import json
    import uuid

    from tessera.plans.recipe import execute_recipe
    from tessera.session import checkpoint_dir
    base = checkpoint_dir(spark).rstrip("/") + "/recipe-test-" + uuid.uuid4().hex
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "id long, x double")
    r = Recipe()
    r.add("fill_missing", columns=["x"], strategy="mean")
    r.approve_all()
    with pytest.raises(ValueError):
        execute_recipe(r, df, base)  # a learned step needs an explicit fit source
    m1 = execute_recipe(r, df, base, fit_source=df)
    m2 = execute_recipe(r, df, base, fit_source=df)
    assert m1["path"].endswith("/v1") and m2["path"].endswith("/v2") and m1["rows"] == 3
    assert sorted(spark.read.parquet(m2["path"]).collect()) == [(1, 2.0), (2, 3.0), (3, 4.0)]
    side = json.loads("".join(r.value for r in spark.read.text(m1["path"] + ".json").collect()))
    assert side["rows"] == 3 and side["path"] == m1["path"]


def test_open_dataset_folder_glob_list_and_recipe_file(spark):
    import uuid

    from tessera.plans.recipe import FittedRecipe, fit_recipe
    from tessera.session import checkpoint_dir
    from tessera.sources.readers import open_dataset
    base = checkpoint_dir(spark).rstrip("/") + "/sources-" + uuid.uuid4().hex
    a = spark.createDataFrame([(1, "x")], "id long, s string")
    b = spark.createDataFrame([("y", 2)], "s string, id long")  # same name set, other order
    a.coalesce(1).write.parquet(base + "/in/a")
    b.coalesce(1).write.parquet(base + "/in/b")
    part_a = [n for n in spark.read.text(base + "/in/a").inputFiles() if n.endswith(".parquet")][0]
    part_b = [n for n in spark.read.text(base + "/in/b").inputFiles() if n.endswith(".parquet")][0]
    by_list = open_dataset(spark, [part_a, part_b])
    assert sorted(by_list.select("id", "s").collect()) == [(1, "x"), (2, "y")]
    by_glob = open_dataset(spark, base + "/in/*/*.parquet")
    assert by_glob.count() == 2
    by_folder = open_dataset(spark, base + "/in/a")
    assert by_folder.collect() == [(1, "x")]
    with pytest.raises(FileNotFoundError):
        open_dataset(spark, base + "/missing.parquet")
    r = Recipe()
    r.add("fill_missing", columns=["id"], strategy="mean")
    fitted = fit_recipe(r.approve_all(), a)
    fitted.save(spark, base + "/recipe.json")
    assert FittedRecipe.load(spark, base + "/recipe.json").to_dict() == fitted.to_dict()
    with pytest.raises(FileExistsError):
        fitted.save(spark, base + "/recipe.json")


def test_values_that_an_integer_column_cannot_hold(spark):
    from tessera.operators.transforms import build_step
    df = spark.createDataFrame([(1,), (None,)], "n int")
    step = build_step("find_replace", {"columns": ["n"], "find": 1.5, "replace": 2})
    assert {r.n for r in step.apply(df).collect()} == {1, None}
    with pytest.raises(ValueError):
        build_step("find_replace", {"columns": ["n"], "find": 1, "replace": 2.7}).apply(df)


def test_map_categories_types(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "n int, s string")

    def run(column, pairs, unknown="keep"):
        out = X.MapCategories([column], [{"from": k, "to": v} for k, v in pairs], unknown).apply(df).select(column)
        return out.dtypes[0][1], [r[0] for r in out.collect()]
    assert run("n", [(1, 7)]) == ("int", [7, 2, None])
    assert run("n", [(1, 0.5)]) == ("double", [0.5, 2.0, None])
    assert run("n", [(1, "x")], "missing") == ("string", ["x", None, None])
    assert run("s", [("a", True), ("b", False)], "error") == ("boolean", [True, False, None])
    assert run("n", [("a", 3), (2, 9)]) == ("int", [1, 9, None])  # a text is no number: matches nothing
    for column, pairs, unknown in [("n", [(1, "x")], "keep"), ("s", [("a", 1), ("b", "y")], "missing"),
                                   ("s", [("a", "z")], "error")]:
        with pytest.raises(ValueError):
            run(column, pairs, unknown)


def test_fills_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "n int, s string")
    for column, value in (("n", 0.5), ("n", "x"), ("s", 3), ("n", None), ("n", float("nan"))):
        with pytest.raises(ValueError):
            X.FillMissing([column], value=value).apply(df)
    assert [r["n"] for r in X.FillMissing(["n"], value=2.0).apply(df).collect()] == [1, 2]


def test_datetime_with_and_without_zone(spark):
    df = spark.createDataFrame([("2024-02-29T23:05:06",)], "t string")
    for utc, kind in ((True, "timestamp"), (False, "timestamp_ntz")):
        step = X.ConvertType(["t"], "datetime", format="%Y-%m-%dT%H:%M:%S", utc=utc)
        assert step.apply(df).dtypes == [("t", kind)] and X.build_step(step.name, step.params()).utc == utc


def test_row_ranges_past_the_end_and_blank_parts(spark):
    df = spark.range(1, 6)
    assert parse_ranges("1,, 3 - 4 ,") == [(1, 1), (3, 4)]
    assert filter_ranges(df, F.col("id"), "2-5", total=5).count() == 4
    with pytest.raises(ValueError):
        filter_ranges(df, F.col("id"), "2-9", total=5)
    with pytest.raises(ValueError):
        parse_ranges(" , ")


def test_declared_types_are_read_as_written(spark):
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.sources.readers import open_dataset
    path = checkpoint_dir(spark).rstrip("/") + f"/typed-{uuid.uuid4().hex}"
    spark.createDataFrame([("001", 1), ("1e3", 2)], "code string, n int").coalesce(1).write.option("header", True).csv(path)
    out = open_dataset(spark, path, dtype={"code": "string", "n": "double"})
    assert sorted(map(tuple, out.collect())) == [("001", 1.0), ("1e3", 2.0)]


def test_suggestions_leave_text_and_dates(spark):
    import datetime as dt

    from tessera.plans.recipe import suggest_recipe
    rows = [(None if i == 3 else float(i), None if i == 4 else f"words {i}", None if i == 5 else dt.date(2024, 1, 1 + i),
             None if i == 6 else "ab"[i % 2]) for i in range(25)]
    df = spark.createDataFrame(rows, "x double, t string, d date, c string")
    found = {s.params["columns"][0]: s.params["strategy"] for s in suggest_recipe(df).steps}
    assert found == {"x": "mean", "c": "mode"}
    assert suggest_recipe(df, numeric_missing="median").steps[0].params["strategy"] == "median"
    with pytest.raises(ValueError):
        suggest_recipe(df, protected=("nowhere",))


def test_update_stream_drops_late_rows(spark):
    import datetime as dt
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.streaming import streams as S
    path = checkpoint_dir(spark).rstrip("/") + f"/late-{uuid.uuid4().hex}"
    day = dt.datetime(2024, 5, 1)
    # batches in order of writing: day 1, day 10 twice (Spark drops by the watermark of the batch before), then
    # day 1 again, nine days late
    for at in (day, day + dt.timedelta(days=9), day + dt.timedelta(days=9), day):
        spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = S.read_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
    out = S.run_available(S.period_counts_stream(stream, "ts", "1 day", "1 hour"), "update")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r["_batch"]):
        last[r["period"]] = r["count"]
    assert sorted(last.values()) == [1, 2]


def test_class_coverage_splits_all_orders(spark, tmp_path):
    """U04 splits every order by class; classes that training lacks are found, but a stratified split leaves none."""
    from tessera.operators.encoding import unseen_classes
    from tessera.plans.io_queries import q_coverage
    rows = [(i, i, "A" if i < 30 else "B" if i < 35 else None) for i in range(40)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string")
    orders.union(orders).write.parquet(f"{tmp_path}/orders.parquet")  # keys repeat
    found = q_coverage(spark, str(tmp_path))
    assert found.columns == ["o_orderstatus"] and found.collect() == []
    assert [r[0] for r in unseen_classes(orders.dropna(), orders.where("o_orderstatus <> 'B'"), "o_orderstatus").collect()] == ["B"]


def test_random_split_passes_over_its_rows_three_times(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.range(500).mapInPandas(seen, "id long")
    got = split_assign(df, SplitConfig("random", 0.8, 0.2, 0.0), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 400, "validation": 100}
    assert read.value == 1500  # buckets, cuts and the split itself
