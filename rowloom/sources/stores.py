"""Stores for predictions, search trials and fitted models, all in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.columns import col

# what a stored prediction stands for
KINDS = ("oof", "test_single", "test_full", "ens")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except AnalysisException as error:
        # an absent path and one without files read alike
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


class PredictionStore:
    """Predictions by level, model and kind, keyed by row id.

    Stored as one table partitioned by these three, so that reading some models
    touches their files only. A save replaces its own partition and no other.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/preds"

    def save(self, preds: DataFrame, level: str, model_id: str, kind: str, id_col: str = "id",
             value: str = "pred") -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        rows = preds.select(
            col(id_col).alias("id"), col(value).alias("pred"),
            F.lit(level).alias("level"), F.lit(model_id).alias("model_id"), F.lit(kind).alias("kind"),
        )
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("level", "model_id", "kind").parquet(self.path)
        )

    def load(self, level: str, model_ids: Sequence[str], kind: str) -> DataFrame:
        """Long table ``(model_id, id, pred)`` of the named models."""
        whole = self.spark.read.parquet(self.path)
        kinds = [f for f in whole.schema if f.name not in ("level", "model_id", "kind")]
        # names of models stay texts ("01" is not "1"); the filter reads the named partitions only
        schema = T.StructType([*kinds, *[T.StructField(n, T.StringType()) for n in ("level", "model_id", "kind")]])
        table = self.spark.read.schema(schema).parquet(self.path)
        wanted = (F.col("level") == level) & (F.col("kind") == kind) & F.col("model_id").isin(list(model_ids))
        return table.where(wanted).select("model_id", "id", "pred")


TRIAL_SCHEMA = "trial long, params map<string,string>, value double, state string"


class TrialStore:
    """Search trials by study; appended as they finish, so an ended search can be resumed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/trials"

    def _path(self, study: str) -> str:
        return f"{self.root}/study={study}"

    def append(self, study: str, trials: DataFrame) -> None:
        trials.select("trial", "params", F.col("value").cast("double"), "state").write.mode(
            "append"
        ).parquet(self._path(study))

    def load(self, study: str) -> DataFrame:
        """All trials of the study; an unknown study is an empty one.

        A trial that was appended more than once is one row, a scored one if there is any.
        """
        path = self._path(study)
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], f"study string, {TRIAL_SCHEMA}")
        table = self.spark.read.schema(TRIAL_SCHEMA).parquet(path)
        rank = F.struct(F.col("value").isNotNull(), "state", F.col("params").cast("string"))
        best = table.groupBy("trial").agg(F.max_by(F.struct("params", "value", "state"), rank).alias("b"))
        return best.select(F.lit(study).alias("study"), "trial", "b.params", "b.value", "b.state")

    def compact(self, study: str) -> None:
        """Put the study's many small files into one.

        The one file is added before the others go, and a trial counts once, so an end at any moment loses nothing.
        """
        path = self._path(study)
        if not _exists(self.spark, path):
            return
        old = [f for f in self.spark.read.parquet(path).inputFiles()]
        self.load(study).drop("study").coalesce(1).write.mode("append").parquet(path)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in old:
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            place.getFileSystem(conf).delete(place, False)
        self.spark.catalog.refreshByPath(path)

    def intend(self, study: str, drawn: DataFrame) -> None:
        """Log the candidates (trial, drawn) that a run is about to try."""
        drawn.select("trial", "drawn").coalesce(1).write.mode("append").parquet(f"{self.root}-intents/study={study}")

    def _intents(self, study: str) -> DataFrame:
        path = f"{self.root}-intents/study={study}"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], "trial long, drawn string")
        return self.spark.read.schema("trial long, drawn string").parquet(path).dropDuplicates(["trial"])

    def lost(self, study: str) -> DataFrame:
        """Candidates that were to be tried and have no trial."""
        return self.remaining(study, self._intents(study))

    def next_number(self, study: str) -> int:
        """One more than any trial that was tried or to be tried."""
        both = self.load(study).select("trial").unionByName(self._intents(study).select("trial"))
        last = both.agg(F.max("trial")).first()[0]
        return 0 if last is None else last + 1

    def remaining(self, study: str, candidates: DataFrame) -> DataFrame:
        """Candidates the study has no trial for yet."""
        return candidates.join(self.load(study).select("trial"), "trial", "left_anti")

    def delete(self, study: str) -> None:
        """Empty the study's own folder; others are not touched."""
        self.spark.createDataFrame([], TRIAL_SCHEMA).write.mode("overwrite").parquet(
            self._path(study)
        )
        self.spark.createDataFrame([], "trial long, drawn string").write.mode("overwrite").parquet(f"{self.root}-intents/study={study}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
