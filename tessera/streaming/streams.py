"""Structured Streaming versions of the incremental work.

* T01 / T02: a fitted recipe (and a model) applied to a stream -- narrow, stateless;
* T03: a mergeable profile (counts, sums, moments, min/max, missing) as a streaming aggregate;
* T04: counts / aggregates per period with an event-time watermark (lateness bound chosen by
  the caller; the reference has none).

``run_available`` drives a stream with ``trigger(availableNow=True)`` into a Parquet folder under the
shared checkpoint directory, with the stream checkpoint beside it (so a restarted driver resumes),
and returns the result as a batch frame.  A batch that is run again leaves the same output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import finite_or_null, is_missing
from tessera.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet file stream over a folder; a single file is streamed from its folder through
    ``pathGlobFilter`` (file sources watch directories)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    from tessera.sources.readers import _hadoop_path
    fs, p = _hadoop_path(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def run_available(stream: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Run to completion over the data available now.  ``append`` writes through Spark's file sink, whose
    log admits each batch once; ``complete`` overwrites the output with each batch's result table;
    ``update`` overwrites one folder per batch and adds the column ``_batch`` to the result."""
    spark = stream.sparkSession
    base = checkpoint_dir(spark).rstrip("/") + "/streams/" + (name or uuid.uuid4().hex)
    out_path, ckpt = base + "/data", base + "/checkpoint"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path if mode == "complete" else f"{out_path}/_batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    q = writer.format("parquet").start(out_path) if mode == "append" else writer.foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    from tessera.sources.readers import _hadoop_path
    fs, p = _hadoop_path(spark, out_path)
    schema = stream.schema
    if mode == "update":  # ``_batch=N`` is a partition folder, which Spark reads (files named ``_x`` it skips)
        schema = T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out_path) if fs.exists(p) else spark.createDataFrame([], schema)


def apply_recipe_stream(stream: DataFrame, fitted, carried: list[str] | None = None) -> DataFrame:
    """Fitted recipe on a stream (literals only, no state)."""
    if carried:
        from tessera.plans.prepare import _apply_carrying
        return _apply_carrying(fitted, stream, carried)
    return fitted.apply(stream, strict=False)


def profile_stream(stream: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """Mergeable per-column aggregates (rows, missing, n, sum, mean, var, min, max)."""
    keys = [group] if group else []
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        x = finite_or_null(c)
        aggs += [F.count_if(is_missing(c, stream.schema[c].dataType)).alias(f"{c}_missing"),
                 F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_sum"), F.avg(x).alias(f"{c}_mean"),
                 F.var_samp(x).alias(f"{c}_variance"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return stream.groupBy(*keys).agg(*aggs)


def period_counts_stream(stream: DataFrame, ts: str, period: str = "1 day", lateness: str = "1 hour",
                         value: str | None = None, group: str | None = None) -> DataFrame:
    """Tumbling-window counts (and mean of ``value``) per period with a watermark."""
    keys = [group] if group else []
    aggs = [F.count(F.lit(1)).alias("count")]
    if value:
        aggs.append(F.avg(finite_or_null(value)).alias("mean"))
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):  # watermarks need TIMESTAMP
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    w = stream.withWatermark(ts, lateness).groupBy(F.window(ts, period), *keys).agg(*aggs)
    return w.select(F.col("window.start").alias("period"), *keys, *[a for a in ["count", "mean"] if a == "count" or value])
