"""Session construction and the shared checkpoint folder.

On a cluster the session is built by the platform and ``get_session`` returns it unchanged.
Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` (a shared folder named
by the cluster) and reading it back (``cut_lineage``); a machine-local folder is only created
when nothing is configured, which is the local test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # broadcast only below a checked size; AQE converts joins at runtime from real sizes
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def _submitted() -> set[str]:
    """Names of the settings that spark-submit hands to the application."""
    from pyspark import SparkConf, SparkContext
    if SparkContext._gateway is None and "PYSPARK_GATEWAY_PORT" not in os.environ:
        return set()  # a plain Python program: nothing was submitted
    return {key for key, _ in SparkConf().getAll()}


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master is None and "spark.master" not in _submitted():
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master is not None:  # otherwise the one that the application was submitted with holds
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's ``spark.checkpoint.dir`` when set.

    Only when the setting is absent (local tests) is a private folder under the system temp
    directory created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's code, once per application; an installed package needs no shipping, but does no harm."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    context.addPyFile(path)  # Spark's own file service hands it to the executors
    context._tessera_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and return a frame
    reading it back: lineage is cut, the data survives executor loss, and the input is computed
    exactly once (``Dataset.checkpoint(eager=True)`` computes an unpersisted input twice: once
    for its eager count and again to write the checkpoint files)."""
    spark = df.sparkSession
    path = checkpoint_dir(spark).rstrip("/") + "/tables/" + uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    out._written_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames that ``cut_lineage`` returned, once nothing reads them any
    more (frames that it did not return are left alone)."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
            df._written_path = None
