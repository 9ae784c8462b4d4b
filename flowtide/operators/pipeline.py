"""The behavioural statistics as a `pyspark.ml` estimator and model, and statistics bucketed by key."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.columns import q
from flowtide.operators import behavior


class _BehaviorParams(Params):
    timeCol = Param(Params._dummy(), "timeCol", "column with the time of a flow", TypeConverters.toString)
    groupCols = Param(Params._dummy(), "groupCols", "source and, if any, destination column; found by name when empty", TypeConverters.toListString)
    families = Param(Params._dummy(), "families", "which of periodicity, aggregation, entropy, consistency to learn", TypeConverters.toListString)
    widthSeconds = Param(Params._dummy(), "widthSeconds", "width of a time bin in seconds", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(timeCol="timestamp", groupCols=[], families=["periodicity", "aggregation", "entropy", "consistency"], widthSeconds=3600)


class BehaviorEstimator(Estimator, _BehaviorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the statistics of the rows it is fitted on; what it returns adds them to any table."""

    @keyword_only
    def __init__(self, *, timeCol: str = "timestamp", groupCols: list[str] | None = None, families: list[str] | None = None, widthSeconds: int = 3600):
        super().__init__()
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, timeCol: str = "timestamp", groupCols: list[str] | None = None, families: list[str] | None = None, widthSeconds: int = 3600):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> BehaviorModel:
        chosen = set(self.getOrDefault("families"))
        unknown = chosen - {"periodicity", "aggregation", "entropy", "consistency"}
        if unknown:
            raise ValueError(f"unknown families: {sorted(unknown)}")
        fitted = behavior.fit_features(
            dataset,
            self.getOrDefault("timeCol"),
            self.getOrDefault("groupCols") or None,
            width_seconds=self.getOrDefault("widthSeconds"),
            **{f: f in chosen for f in ("periodicity", "aggregation", "entropy", "consistency")},
        )
        return self._copyValues(BehaviorModel(fitted))


class BehaviorModel(Model, _BehaviorParams, MLReadable, MLWritable):
    """Fitted statistics; `transform` joins them to a table."""

    def __init__(self, fitted: behavior.FittedBehavior | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return behavior.transform_features(dataset, self.fitted)

    def write(self) -> MLWriter:
        return _BehaviorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BehaviorReader(cls)


class _BehaviorWriter(MLWriter):
    """Parameters as `pyspark.ml` writes them, the tables as Parquet beside them."""

    def __init__(self, model: BehaviorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        fitted = self.model.fitted
        extra = {"keys": fitted.group_columns if fitted else []}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        for name in ("pair_stats", "src_stats", "hot_pairs", "hot_sources"):
            table = getattr(fitted, name, None)
            if table is not None:
                table.write.parquet(f"{path}/tables/{name}")


class _BehaviorReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BehaviorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        fitted = behavior.load_features(self.sparkSession, f"{path}/tables", metadata["keys"])
        for name in ("hot_pairs", "hot_sources"):
            if _there(self.sparkSession, f"{path}/tables/{name}"):
                setattr(fitted, name, self.sparkSession.read.parquet(f"{path}/tables/{name}"))
        model = self.cls(fitted)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """Saves a table cut into buckets by its keys and sorted in each; two tables saved alike join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def apply_bucketed(flows: DataFrame, stats: DataFrame, keys: list[str], new: list[str], zero: bool = True) -> DataFrame:
    """Left join of flows and statistics that were saved alike: each bucket is merged where it lies, whatever the sizes.

    Both sides must come from `save_bucketed` with the same keys and number of buckets. Unseen keys get 0.
    """
    joined = flows.join(stats.select(*[q(k) for k in keys], *[q(c) for c in new]).hint("merge"), keys, "left")
    filled = [F.coalesce(q(c), F.lit(0).cast(stats.schema[c].dataType)).alias(c) if zero else q(c) for c in new]
    return joined.select(*[q(c) for c in flows.columns], *filled)

