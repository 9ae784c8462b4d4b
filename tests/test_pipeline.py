"""The estimator inside a Pipeline, saved and read in another session; bucketed joins."""

import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from flowtide.catalog.behavior import PAIR, parted
from flowtide.functions.columns import q
from flowtide.operators import behavior
from flowtide.operators.pipeline import BehaviorEstimator, apply_bucketed, save_bucketed

SF = "/root/testdata/sf0.001"
READ = """
import sys
sys.path.insert(0, {root!r})
from pyspark.ml import PipelineModel
from flowtide.session import build_session
spark = build_session("again", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
model = PipelineModel.load({path!r})
model.transform(spark.read.parquet({rows!r})).write.parquet({out!r})
"""


def same(a, b):
    columns = a.columns
    assert columns == b.columns
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_a_saved_pipeline_gives_the_same_rows_in_a_fresh_session(spark, tmp_path):
    df = parted(spark, SF)
    train = df.where(q("split") == "train")
    slim = SQLTransformer(statement="SELECT *, 1 AS one FROM __THIS__")
    model = Pipeline(stages=[slim, BehaviorEstimator(groupCols=list(PAIR))]).fit(train)
    rows = df.select("event_id", *PAIR)
    want = behavior.transform_features(rows.withColumn("one", F.lit(1)), behavior.fit_features(train))
    same(model.transform(rows), want)
    path, given, out = (str(tmp_path / n) for n in ("model", "rows", "out"))
    model.write().overwrite().save(path)
    rows.write.parquet(given)
    same(PipelineModel.load(path).transform(rows), want)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", READ.format(root=root, path=path, rows=given, out=out)], check=True, timeout=150, cwd=tmp_path)
    same(spark.read.parquet(out), want)


def test_parameters_choose_families_and_survive_saving(spark, tmp_path):
    estimator = BehaviorEstimator(families=["entropy"], widthSeconds=7200)
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    again = BehaviorEstimator.load(str(tmp_path / "estimator"))
    assert again.getOrDefault("families") == ["entropy"] and again.getOrDefault("widthSeconds") == 7200
    added = set(again.fit(parted(spark, SF)).transform(parted(spark, SF)).columns) - set(parted(spark, SF).columns)
    assert added == {"dst_port_entropy", "protocol_entropy"}
    with pytest.raises(ValueError, match="unknown"):
        BehaviorEstimator(families=["other"]).fit(parted(spark, SF))


def test_bucketed_statistics_join_without_an_exchange(spark):
    df = parted(spark, SF).select("event_id", *PAIR, "timestamp", "split")
    stats = behavior.fit_periodicity(df.where(q("split") == "train"), list(PAIR), "timestamp")
    new = list(behavior.IAT_COLUMNS)
    try:
        flows_table = save_bucketed(df, "flows_bucketed", list(PAIR), 4)
        stats_table = save_bucketed(stats.select(*PAIR, *new), "stats_bucketed", list(PAIR), 4)
        joined = apply_bucketed(flows_table, stats_table, list(PAIR), new)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = behavior.apply_pair_stats(df, stats, list(PAIR)).drop("periodicity_score")
        same(joined.select(*want.columns), want)
    finally:
        spark.sql("DROP TABLE IF EXISTS flows_bucketed")
        spark.sql("DROP TABLE IF EXISTS stats_bucketed")
