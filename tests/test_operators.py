"""Hand-made cases and properties."""

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowtide.functions import columns as c
from flowtide.functions.columns import q
from flowtide.operators import averaging, behavior, evaluate, explore, models, rows, sampling, scale
from flowtide.plans import datasets
from flowtide.session import scratch_path
from flowtide.sources import files, schema


def one(df):
    return df.first().asDict()


def test_ports(spark):
    texts = ["0x50", "0X50", "0x1g", "0x", "80.0", " 80 ", "-", None, "-5", "99999999999", "443"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = df.select(c.parse_port(q("p")).alias("z"), c.parse_port(q("p"), "null").alias("n")).collect()
    assert [r["z"] for r in got] == [80, 0, 0, 0, 0, 80, 0, 0, -5, 0, 443]
    assert [r["n"] for r in got] == [80, None, None, None, None, 80, None, None, -5, None, 443]


def test_times(spark):
    df = spark.createDataFrame([("2011/08/10 09:46:59.607825",), ("junk",), (None,)], "t string")
    got = [r[0] for r in df.select(c.parse_timestamp(q("t"), c.CTU_TIME_FORMAT)).collect()]
    assert got == [dt.datetime(2011, 8, 10, 9, 46, 59, 607825), None, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (3.0, None)], "`x.y` double, s string")
    assert rows.fill_missing(df, "drop").count() == 1
    assert [r[0] for r in rows.fill_missing(df, "fill_zero").collect()] == [1.0, 0.0, 0.0, 3.0]
    assert [r[0] for r in rows.fill_missing(df, "fill_median").collect()] == [1.0, 2.0, 2.0, 3.0]
    assert {r["column"]: r["missing"] for r in explore.missing_counts(df).collect()} == {"x.y": 2, "s": 1}


def test_exclude_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r[0] for r in rows.apply_filters(df, {"x": {"exclude": ["a"]}}).collect()] == ["b", None]
    with pytest.raises(KeyError):
        rows.apply_filters(df, {"nope": {"min": 1}})


def test_one_hot_names(spark):
    df = spark.createDataFrame([("ipx/spx",), (".A....",), ("a-b",), (None,)], "p string")
    out = rows.one_hot_topk(df, "p", 2, "proto")
    assert out.columns == ["p", "proto_.A....", "proto_a-b"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0), (1, 0), (0, 1), (0, 0)]
    path = scratch_path(spark, "dotted")
    assert spark.read.parquet(files.write_flows(out, path)).columns == out.columns


def test_select_features_guards(spark):
    df = spark.createDataFrame([(1, "x", True, 2.0)], "a long, b string, f boolean, label double")
    assert rows.select_features(df, ["a"], "label") == ["f"]
    with pytest.raises(KeyError):
        rows.select_features(df, [], "label", ["zz"])
    with pytest.raises(ValueError):
        rows.select_features(df, ["a", "f"], "label")


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r[0] for r in rows.standard_scale(df, rows.fit_scaler(df, ["x"])).collect()] == [0.0, 0.0]


FLOW = "src_ip string, dst_ip string, timestamp timestamp_ntz, dst_port long, protocol string, bytes_total double, total_packets long"
T0 = dt.datetime(2024, 1, 1, 10, 30)


def flow(src, dst, seconds, port=80, proto="TCP", size=100.0, packets=3):
    return (src, dst, T0 + dt.timedelta(seconds=seconds), port, proto, size, packets)


@pytest.fixture(scope="module")
def train(spark):
    beacon = [flow("beacon", "c2", 60 * i) for i in range(10)]
    single = [flow("single", "x", 0, port=None)]
    pair = [flow("pair", "x", 0), flow("pair", "x", 30, size=200.0)]
    gaps = [flow("gaps", "x", 0, port=1), flow("gaps", "x", 3 * 3600, port=2)]
    return spark.createDataFrame(beacon + single + pair + gaps + [flow(None, "x", 5)], FLOW)


@pytest.fixture(scope="module")
def applied(spark, train):
    fitted = behavior.fit_features(train)
    fresh = spark.createDataFrame(
        [flow(s, d, 0) for s, d in (("beacon", "c2"), ("beacon", "x"), ("single", "x"), ("pair", "x"), ("gaps", "x"), ("new", "x"), (None, "x"))],
        FLOW,
    )
    out = behavior.transform_features(fresh, fitted)
    return {(r["src_ip"], r["dst_ip"]): r for r in out.collect()}, out.columns


def test_behaviour_column_order(applied):
    # The 21 appended columns in output order.
    assert applied[1][7:] == [
        "iat_mean", "iat_std", "iat_median", "iat_min", "iat_max", "iat_cv", "periodicity_score",
        "flow_count_mean", "flow_count_std", "flow_count_max", "flow_count_total",
        "dst_port_entropy", "protocol_entropy",
        "bytes_mean", "bytes_std", "bytes_cv", "bytes_consistency_score",
        "pkts_mean", "pkts_std", "pkts_cv", "pkts_consistency_score",
    ]


def test_regular_beacon(applied):
    r = applied[0]["beacon", "c2"]
    assert (r["iat_mean"], r["iat_std"], r["iat_median"], r["iat_cv"]) == (60.0, 0.0, 60.0, 0.0)
    assert r["periodicity_score"] == pytest.approx(1e9)
    assert (r["flow_count_total"], r["flow_count_std"], r["bytes_std"]) == (10, 0.0, 0.0)
    assert r["dst_port_entropy"] == 0.0


def test_small_and_unseen_groups(applied):
    found = applied[0]
    for key in (("single", "x"), ("new", "x"), (None, "x"), ("beacon", "x")):
        r = found[key]
        assert (r["iat_mean"], r["iat_std"], r["iat_cv"]) == (0.0, 0.0, 0.0)
        assert r["periodicity_score"] == pytest.approx(1e9)
    assert found["new", "x"]["flow_count_total"] == 0
    assert found[None, "x"]["bytes_mean"] == 0.0
    two = found["pair", "x"]
    assert (two["iat_mean"], two["iat_std"], two["iat_cv"]) == (30.0, 0.0, 0.0)
    assert two["bytes_std"] == pytest.approx(math.sqrt(5000))


def test_empty_hours_count_as_zero(applied):
    r = applied[0]["gaps", "x"]
    assert (r["flow_count_mean"], r["flow_count_max"], r["flow_count_total"]) == (0.5, 1, 2)
    assert r["flow_count_std"] == pytest.approx(np.std([1, 0, 0, 1], ddof=1))
    assert r["dst_port_entropy"] == pytest.approx(math.log(2))


def test_family_switches_and_guards(spark, train):
    fitted = behavior.fit_features(train, periodicity=False, entropy=False)
    out = behavior.transform_features(train, fitted)
    assert "iat_mean" not in out.columns and "dst_port_entropy" not in out.columns and "bytes_cv" in out.columns
    assert out.count() == train.count()
    with pytest.raises(ValueError):
        behavior.transform_features(train, None)
    bare = train.drop("src_ip", "dst_ip")
    assert behavior.transform_features(bare, behavior.fit_features(bare)).columns == bare.columns
    with pytest.raises(ValueError):
        behavior.fit_flow_counts(train, "src_ip", "timestamp", 7 * 3600)


def test_split_sizes_of_the_published_dataset(spark):
    """2,799,999 rows at 0.2 / 0.1 give 1,959,999 / 280,000 / 560,000."""
    df = spark.range(2_799_999).select((F.col("id") % 69 == 0).cast("int").alias("label"))
    r = one(sampling.split_sizes(df, 0.2, 0.1, "label").agg(F.sum("train_rows").alias("a"), F.sum("val_rows").alias("b"), F.sum("test_rows").alias("c")))
    assert (r["a"], r["b"], r["c"]) == (1_959_999, 280_000, 560_000)


def test_samples_larger_than_the_table(spark):
    df = spark.range(20)
    assert sampling.sample_exact(df, 50, ["id"], 1).count() == 20
    few = df.withColumn("y", (F.col("id") < 2).cast("int"))
    out = sampling.stratified_sample(few, 10, 0.5, q("y") == 1, ["id"], 1).collect()
    assert Counter(r["y"] for r in out) == {1: 2, 0: 8}


def test_kfold_shares(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    out = sampling.stratified_kfold(df, 5, "y", ["id"], 1).collect()
    assert sorted(Counter(r["fold"] for r in out).values()) == [20, 20, 21, 21, 21]
    ones = Counter(r["fold"] for r in out if r["y"] == 1)
    assert max(ones.values()) - min(ones.values()) <= 1


def test_group_kfold_keeps_groups_whole(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 130, "big").when(F.col("id") % 50 > 0, F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = sampling.stratified_group_kfold(df, 4, "y", "g", 1).collect()
    assert len(out) == 400
    folds = defaultdict(set)
    for r in out:
        folds[r["g"]].add(r["fold"])
    assert all(len(f) == 1 for f in folds.values())
    assert {r["fold"] for r in out} == {0, 1, 2, 3}


def test_group_kfold_deals_a_rare_class_to_every_fold(spark):
    pure = spark.range(20 * 210).select((F.col("id") % 210).alias("g")).withColumn("y", (F.col("g") < 10).cast("int"))
    mixed = spark.range(300).select((F.col("id") % 30).alias("g"), F.when(F.col("id") % 30 < 6, 2).when(F.col("id") % 2 == 0, None).otherwise(0).alias("y"))
    for df, k, largest in ((pure, 5, 0), (pure, 4, 20), (mixed, 4, 10)):
        for seed in range(2):
            out = sampling.stratified_group_kfold(df, k, "y", "g", seed).collect()
            assert len(out) == df.count()
            for y in {r["y"] for r in out}:
                held = Counter(r["fold"] for r in out if r["y"] == y)
                assert all(abs(held[f] - sum(held.values()) / k) <= largest for f in range(k)), (y, seed, held)


def test_time_folds_never_look_ahead(spark):
    df = spark.range(100).withColumn("t", F.timestamp_seconds(F.floor(F.col("id") / 3) * 100).cast("timestamp_ntz"))
    out = sampling.time_series_split(df, 4, "t", ["id"], gap=2).collect()
    for f in range(4):
        train = [r["t"] for r in out if (r["fold"], r["role"]) == (f, "train")]
        test = [r["t"] for r in out if (r["fold"], r["role"]) == (f, "test")]
        assert len(test) == 20 and len(train) == 20 * (f + 1) - 2
        assert max(train) <= min(test)
    with pytest.raises(ValueError):
        sampling.time_series_bounds(10, 5, 3)


def test_dirichlet_clients_cover_all_rows(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 5).cast("int"))
    out = sampling.partition_dirichlet(df, 6, "y", ["id"], 3, alpha=0.3)
    assert out.count() == 500 and out.select("id").distinct().count() == 500
    empty = sampling.partition_dirichlet(df, 3, "y", ["id"], 3, proportions={i: [0.5, 0.0, 0.5] for i in range(5)})
    assert {r[0] for r in empty.select("client_id").distinct().collect()} == {0, 2}


def test_client_validation_rows(spark):
    df = spark.createDataFrame([(0, 1, 0)] + [(i, 2, i % 2) for i in range(1, 12)], "id long, client_id int, y int")
    out = sampling.client_val_split(df, 0.25, "y", ["id"], 1).collect()
    assert [r["split"] for r in out if r["client_id"] == 1] == ["train"]
    assert Counter(r["split"] for r in out if r["client_id"] == 2) == {"train": 8, "val": 3}


def scored(spark, rows_):
    return spark.createDataFrame(rows_, "label int, score double").withColumn("prediction", (q("score") >= 0.5).cast("int"))


@pytest.mark.parametrize(
    "rows_, roc",
    [
        ([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], 1.0),
        ([(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9)], 0.0),
        ([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], 0.5),
        ([(0, 0.1), (0, 0.2)], 0.0),
    ],
)
def test_areas(spark, rows_, roc):
    assert one(evaluate.auc_scores(scored(spark, rows_)))["roc_auc"] == pytest.approx(roc)


def test_pr_area_starts_at_precision_one(spark):
    """Top score is a negative: (0,1) -> (0,0) -> (.5,.5) -> (1,2/3) -> (1,.5)."""
    r = one(evaluate.auc_scores(scored(spark, [(0, 0.9), (1, 0.8), (1, 0.7), (0, 0.1)])))
    assert r["pr_auc"] == pytest.approx(0.5 * (0 + 0.5) / 2 + 0.5 * (0.5 + 2 / 3) / 2)


def test_one_class_metrics(spark):
    r = one(evaluate.binary_metrics(scored(spark, [(0, 0.1), (0, 0.9)])))
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 1, 0, 0)
    assert (r["precision"], r["recall"], r["f1"], r["mcc"], r["imbalance_ratio"]) == (0, 0, 0, 0, None)


def test_weighted_average_counts_absent_metric_as_zero(spark):
    df = spark.createDataFrame([(0, 10, "a", 1.0), (1, 30, "a", 0.0), (0, 10, "b", 0.8)], "client_id int, num_examples long, metric string, value double")
    assert {r["metric"]: r["average"] for r in evaluate.weighted_metric_average(df).collect()} == pytest.approx({"a": 0.25, "b": 0.2})


def test_probability_without_threshold(spark):
    r = one(evaluate.anomaly_scores(spark.createDataFrame([(0.0,)], "error double"), "error", 0.0))
    assert (r["prediction"], r["score"]) == (0, 0.5)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert [r["flows"] for r in explore.histogram(df, "x", 2).orderBy("bin").collect()] == [1, 2]
    flat = spark.createDataFrame([(0.0, 1), (0.0, 0)], "x double, f int")
    assert rows.clip_limit(flat, "x", 0.95) == 1.0
    assert explore.class_histogram(flat, "x", "f", 0.99, fall_back=False).count() == 100


def test_load_splits_guards(spark):
    described = schema.processed_data(scratch_path(spark, "absent"))
    with pytest.raises(FileNotFoundError):
        files.load_splits(spark, described, ["train"], allow_missing=True)
    assert described.label == "label" and "Te" in described.not_features


def test_csv_without_label_is_refused(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("1",)], "a string").write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        files.read_flow_csv(spark, path, required=["Label"])


@pytest.fixture(scope="module")
def clients(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) * 0.3 > 0).astype(int)
    cid = np.where(np.arange(300) < 200, 0, np.arange(300) % 3)
    data = [(int(c_), int(l), float(a), float(b)) for c_, l, (a, b) in zip(cid, y, x)]
    return spark.createDataFrame(data, "client_id int, label int, a double, b double").repartition(5).persist()


def brute_round(rows_, w, epochs, rate, mu):
    start, w = np.array(w), np.array(w)
    x = np.array([[r["a"], r["b"], 1.0] for r in rows_])
    y = np.array([r["label"] for r in rows_])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - rate * (x.T @ (p - y) / len(y) + mu * (w - start))
    return w


@pytest.mark.parametrize("mu", [0.0, 0.7])
def test_local_update_equals_brute_force(clients, mu):
    out = averaging.local_update(clients, [0.1, 0.0, -0.2], ["a", "b"], epochs=3, mu=mu).collect()
    for r in out:
        mine = [x for x in clients.collect() if x["client_id"] == r["client_id"]]
        assert r["n"] == len(mine)
        assert r["weights"] == pytest.approx(brute_round(mine, [0.1, 0.0, -0.2], 3, 0.5, mu))


def test_averaging_rounds(clients):
    weights, history = averaging.fedavg(clients, ["a", "b"], rounds=3)
    same, _ = averaging.fedprox(clients, ["a", "b"], mu=0.0, rounds=3)
    assert weights == pytest.approx(same)
    losses = [r["train_loss"] for r in history.orderBy("round").collect()]
    assert losses[-1] < losses[0]
    alone = clients.where("client_id = 0")
    one_client, _ = averaging.fedavg(alone, ["a", "b"], rounds=1, min_clients=1)
    assert one_client == pytest.approx(brute_round(alone.collect(), [0, 0, 0], 1, 0.5, 0))
    with pytest.raises(ValueError):
        averaging.fedavg(alone, ["a", "b"])


def test_models_learn_and_guard(spark, clients):
    table = rows.assemble(clients.withColumn("id", F.monotonically_increasing_id()), ["a", "b"])
    model = models.random_forest(table, trees=5, depth=4)
    assert one(evaluate.all_metrics(models.predict(model, table)))["roc_auc"] > 0.9
    names = {r["feature"] for r in models.feature_importances(model, ["a", "b"]).collect()}
    assert names == {"a", "b"}
    path = scratch_path(spark, "model")
    model.write().save(path)
    with pytest.raises(ValueError):
        models.predict(None, table)
    detector = models.reconstruction_detector(table, 2)
    assert models.reconstruction_error(detector, table).agg(F.max("error")).first()[0] == pytest.approx(0, abs=1e-9)


def test_models_score_after_rows_were_observed(spark):
    """The session that has observed rows cannot be sent to tasks; a model must not hold it."""
    seen = Observation()
    df = rows.assemble(spark.range(60).selectExpr("CAST(id % 2 AS INT) AS label", "CAST(id % 2 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b"), ["a", "b"])
    assert df.observe(seen, F.count(F.lit(1)).alias("n")).count() == seen.get["n"] == 60
    for model in (models.random_forest(df, trees=3, depth=3), models.boosted_trees(df, rounds=2, depth=2), models.mlp(df, 2, hidden=(3,), iterations=40)):
        assert one(evaluate.all_metrics(models.predict(model, df)))["accuracy"] == 1


def test_fit_ignores_test_rows(spark):
    """Statistics joined to train rows stay the same when only test rows change."""
    raw = [(i, f"s{i % 3}", f"d{i % 2}", i) for i in range(60)]
    df = spark.createDataFrame(raw, "id long, src_ip string, dst_ip string, n long")
    df = df.withColumn("timestamp", F.timestamp_seconds(F.col("n") * (F.col("n") % 7 + 1)).cast("timestamp_ntz"))
    split = sampling.stratified_split(df.withColumn("y", F.col("id") % 2), "y", ["id"], 1)
    moved = F.when(F.col("split") == "train", F.col("timestamp")).otherwise(F.expr("timestamp + INTERVAL 9 HOURS"))
    found = []
    for table in (split, split.withColumn("timestamp", moved)):
        fitted = behavior.fit_periodicity(table.where("split = 'train'"), ["src_ip", "dst_ip"], "timestamp")
        found.append(sorted(map(str, fitted.collect())))
        whole = behavior.fit_periodicity(table, ["src_ip", "dst_ip"], "timestamp")
        assert sorted(map(str, whole.collect())) != found[-1]
    assert found[0] == found[1]


def test_ctu_output_columns(spark):
    line = ["2011/08/10 09:46:59.607825", "1.0", "tcp", "1.1.1.1", "0x50", "->", "2.2.2.2", "80", "CON", "0", None, "3", "300", "100", "flow=From-Botnet-V42-TCP"]
    data = [[*line[:3], f"h{i % 4}", *line[4:14], line[14] if i % 5 == 0 else "flow=Background"] for i in range(40)]
    raw = spark.createDataFrame([tuple([i, *d]) for i, d in enumerate(data)], "id long, " + ", ".join(f"{n} string" for n in schema.CTU_COLUMNS))
    out = datasets.preprocess_ctu(raw, ["id"]).drop("id")
    assert len(out.columns) == 15 + 2 + 9 + 1 + 2 + 1 + 21 + 1
    assert out.count() == 40 and out.columns[-1] == "split"
    r = out.where("label = 1").first()
    assert (r["scenario"], r["Sport"], r["is_common_src_port"], r["proto_tcp"]) == ("V42", 80, 1, 1)


def test_rows_without_a_time_come_last(spark):
    rows = [(i, None if i % 5 == 0 else i) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    assert sampling.first_n_by_time(df, 20, "ts", ["id"]).count() == 20
    first = {r.id for r in sampling.first_n_by_time(df, 16, "ts", ["id"]).collect()}
    assert first == {i for i in range(20) if i % 5}
    placed = sampling.time_series_split(df, 4, "ts", ["id"]).collect()
    last = {r.id for r in placed if r.fold == 3 and r.role == "test"}
    assert last == {0, 5, 10, 15}


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_gaps_with_missing_keys_and_ties(spark, hot_rows):
    rows = [(1, "a", "b", 0), (2, "a", "b", 5), (3, "a", "b", 5), (4, "a", "b", 9), (5, None, "b", 1), (6, None, "b", 2), (7, "a", None, 3), (8, "a", "b", None)]
    df = spark.createDataFrame(rows, "id long, src string, dst string, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r.id: r.iat for r in behavior.inter_arrival(df, ["src", "dst"], "ts", hot_rows=hot_rows).collect()}
    assert [got[i] for i in (1, 4, 5, 6, 7, 8)] == [None, 4.0, None, None, None, None]
    assert sorted([got[2], got[3]]) == [0.0, 5.0]
    plain = {r.id: r.iat for r in behavior.inter_arrival(df, ["src", "dst"], "ts").collect()}
    assert plain == got


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_column_quantiles_same_at_any_size(spark, hot_rows):
    df = spark.range(101).select((F.col("id") * 1.5).alias("a"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") % 7).alias("b"), F.lit(None).cast("double").alias("c"))
    got = {(r.column, r.prob): r.quantile for r in scale.column_quantiles(df, ["a", "b", "c"], [0.25, 0.9], hot_rows).collect()}
    known = [float(i % 7) for i in range(101) if i % 3]
    assert got == {("a", 0.25): 37.5, ("a", 0.9): 135.0, ("b", 0.25): float(np.quantile(known, 0.25)), ("b", 0.9): float(np.quantile(known, 0.9))}


def test_fitted_statistics_can_be_loaded_again(spark, train):
    path = scratch_path(spark, "fitted")
    fitted = behavior.fit_features(train, path=path)
    back = behavior.load_features(spark, path, fitted.group_columns)
    assert sorted(back.families) == sorted(fitted.families)
    a, b = (sorted(map(str, behavior.transform_features(train, f).collect())) for f in (fitted, back))
    assert a == b


def test_run_folder_is_empty_afterwards(spark):
    from flowtide.session import materialize, run_folder

    jvm = spark._jvm
    with run_folder(spark) as folder:
        assert materialize(spark.range(5), "numbers").count() == 5
        root = jvm.org.apache.hadoop.fs.Path(folder)
        assert root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    assert not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
