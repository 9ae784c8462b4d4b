"""Times the headline queries end to end and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from flowtide.catalog import QUERIES
from flowtide.session import build_session

HEADLINE = [
    "b3_parse_port",
    "b14_temporal_features",
    "d1_fit_periodicity",
    "d2_fit_flow_counts",
    "d3_fit_port_entropy",
    "d7_fit_features",
    "c5_transform_features",
    "b31_preprocess_ctu",
    "b31_preprocess_ugr",
    "d12_label_summary_ctu",
    "d23_hourly_volume",
    "d26_describe",
    "d28_corr_matrix",
    "d30_class_histogram",
    "h1_sample_exact",
    "h4_stratified_split",
    "h7_time_series_split",
    "h9_partition_dirichlet",
    "i2_binary_metrics",
    "i3_roc_auc",
    "i4_pr_auc",
    "j7_fedavg",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["d8_class_stats"](spark, sf_dir).collect()  # starts the JVM's code paths, not timed
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
