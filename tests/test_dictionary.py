"""Encoders with more tokens and classes than a list holds."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.dictionary import TokenSlots, with_slots
from tessera.operators.encoding import encode_target, fit_encoder, target_classes

ROWS = [("a", 1.0, "x"), ("b", None, "x"), (None, 3.0, "y"), ("a", 0.0, "z"), ("é", 5.0, None), ("10", 2.0, "2"), ("2", 2.0, "10")]
SCHEMA = {"n": "numeric", "c": "categorical", "d": "categorical"}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "c string, n double, d string")


def vectors(df):
    return sorted((str(r["c"]), str(r["d"]), r["features"].size, tuple(r["features"].toArray())) for r in df.collect())


def test_dictionary_gives_the_slots_of_the_lists(spark, table):
    few, many = (fit_encoder(table.where("c is distinct from '2'"), SCHEMA, scale=True, literal_slots=n) for n in (100, 0))
    assert few.slots is None and many.slots is not None and few.width == many.width
    new = table.union(spark.createDataFrame([("new", 7.0, "x"), ("new", 7.0, "new"), ("new", 7.0, "new")], table.schema))
    assert vectors(few.transform(new)) == vectors(many.transform(new))
    assert many.transform(new).columns == few.transform(new).columns
    names = [r["name"] for r in many.feature_table(spark).orderBy("slot").collect()]
    assert names == few.feature_names() == [r["name"] for r in few.feature_table(spark).orderBy("slot").collect()]
    with pytest.raises(ValueError):
        many.feature_names()


def test_the_width_is_limited_where_asked(table):
    for literal in (100, 0):
        with pytest.raises(ValueError):
            fit_encoder(table, SCHEMA, max_features=5, literal_slots=literal)
        with pytest.raises(ValueError):
            target_classes(table, "c", max_classes=3, literal_classes=literal)


def test_classes_in_a_table(spark, table):
    listed, tabled = target_classes(table, "c"), target_classes(table, "c", literal_classes=2)
    assert listed == [r["class_key"] for r in tabled.orderBy("label").collect()]
    new = table.union(spark.createDataFrame([("new", 7.0, "x")], table.schema)).withColumn("_class", F.lit(1)).withColumn("label", F.lit("old"))
    by = [sorted(map(str, encode_target(new, "c", c).select("c", "d", "_class", "label").collect())) for c in (listed, tabled)]
    assert by[0] == by[1]
    none = table.limit(0)
    assert target_classes(none, "c") == [] and encode_target(table, "c", []).where("label is not null").isEmpty()
    assert fit_encoder(none, SCHEMA).transform(none).collect() == []


def test_a_million_tokens(spark):
    """Every token once and one token in a third of the rows."""
    n = 1_000_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("%07d", "id")).alias("t"))
    slots = TokenSlots(rows.select(F.lit("t").alias("column"), F.col("t").alias("token")), ["t"], 5)
    kept = n - -(-n // 3)
    assert slots.width == 5 + kept + 1
    got = with_slots(rows, slots, {"t": "t"}).select("id", F.col("slots")[0].alias("s"), F.size("slots").alias("k"))
    want = F.when(F.col("id") % 3 == 0, 5 + kept).otherwise(5 + F.col("id") - F.floor((F.col("id") + 2) / 3))
    assert got.where((F.col("k") == 1) & (F.col("s") == want)).count() == n


def test_columns_of_few_tokens_are_not_met_row_by_row(spark, monkeypatch):
    from tessera.operators import dictionary
    monkeypatch.setattr(dictionary, "FEW", 4)
    rows = spark.createDataFrame([(i, f"t{i % 40:02d}", "xyz"[i % 3] if i % 5 else None) for i in range(400)], "id long, big string, small string")
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("token")) for c in ("big", "small")])))
    slots, asked, of = TokenSlots(long, ["big", "small"], 2), [], TokenSlots.of
    monkeypatch.setattr(TokenSlots, "of", lambda self, df, row, token_of: asked.append(list(token_of)) or of(self, df, row, token_of))
    new = rows.union(spark.createDataFrame([(1000, "new", "z"), (1001, "new", None)], rows.schema))
    got = {r["id"]: r["slots"] for r in with_slots(new, slots, {"big": "big", "small": "small"}).collect()}
    assert asked == [["big"]]
    assert got == {i: [2 + i % 40] + ([42 + i % 3] if i % 5 else []) for i in range(400)} | {1000: [44], 1001: []}
