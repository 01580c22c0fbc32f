"""Run ledger and comparison cohorts.

Every run is one file of its own, written aside and moved into the ledger, so a run is there as a whole or not at all and
writers never meet in a file.  Runs are only ranked against runs on the same preparation (by its fingerprint); a run without
scores on held-out rows takes part in a cohort of its own kind, labelled as training scores, and is never ranked against others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.readers import _hadoop_path, list_names

SCHEMA = ("run string, dataset string, task string, preparation string, candidate string, basis string, metric string, "
          "score double, at timestamp")
BASES = ("test", "validation", "training")


@dataclass(frozen=True)
class Run:
    """A run's scores: ``scores[basis][candidate][metric]``, basis being test, validation or training."""

    run: str
    dataset: str
    task: str
    preparation: str
    scores: dict = field(default_factory=dict)
    at: str | None = None

    def rows(self) -> list[dict]:
        odd = set(self.scores) - set(BASES)
        if odd or not all((self.run, self.dataset, self.task, self.preparation)):
            raise ValueError(f"a run has a name, dataset, task and preparation, and scores on {BASES}: not {sorted(odd)}")
        own = {k: v for k, v in asdict(self).items() if k != "scores"}
        return [{**own, "basis": basis, "candidate": candidate, "metric": metric, "score": None if score != score else score}
                for basis, by in self.scores.items() for candidate, metrics in by.items() for metric, score in metrics.items()]


class Ledger:
    """Runs under a folder that all writers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, run: Run) -> str:
        """Add a run; the name of its file.  The move is the commit: it fails if the name is taken, and a writer that is lost before it
        leaves nothing that is read."""
        rows = run.rows()
        if not rows:
            raise ValueError(f"{run.run} has no scores")
        name = f"{uuid.uuid4().hex}.json"
        fs, aside = _hadoop_path(self.spark, f"{self.path}/_aside/{name}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
        finally:
            out.close()
        _, place = _hadoop_path(self.spark, f"{self.path}/runs/{name}")
        fs.mkdirs(place.getParent())
        if not fs.rename(aside, place):
            raise FileExistsError(str(place))
        return name

    def runs(self) -> DataFrame:
        """A row per run, basis, candidate and metric."""
        if not list_names(self.spark, f"{self.path}/runs"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(f"{self.path}/runs")


def cohorts(runs: DataFrame, metric: str, direction: str) -> DataFrame:
    """dataset, task, preparation, basis, run, candidate, score, rank and fallback.

    A cohort is what has one dataset, task, preparation and basis.  A run is compared on its best basis that has the metric: test, else
    validation, else training, which is the labelled fallback.  Missing scores come last; equal scores share no rank but go by
    run, then candidate.  Several scores of one candidate of a run (recorded twice) count once, the best."""
    if direction not in ("max", "min"):
        raise ValueError(f"direction is max or min, not {direction}")
    place = F.array_position(F.array(*[F.lit(b) for b in BASES]), F.col("basis"))
    own = ["dataset", "task", "preparation", "run"]
    kept = runs.where(F.col("metric") == metric).withColumn("place", place)
    best = kept.withColumn("least", F.min("place").over(Window.partitionBy(*own))).where("place = least")
    pick = F.max("score") if direction == "max" else F.min("score")
    one = best.groupBy(*own, "basis", "candidate").agg(pick.alias("score"))
    order = F.desc_nulls_last("score") if direction == "max" else F.asc_nulls_last("score")
    rank = F.row_number().over(Window.partitionBy("dataset", "task", "preparation", "basis").orderBy(order, "run", "candidate"))
    return one.withColumn("rank", rank.cast("long")).withColumn("fallback", F.col("basis") == "training").select(
        "dataset", "task", "preparation", "basis", "run", "candidate", "score", "rank", "fallback")
