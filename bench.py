"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from furrow.session import build_session
from verification import QUERIES

HEADLINES = [
    "E11_mart_end_to_end", "V2_valid_rows", "V3_reject_messages", "S7_scd2_merge", "A_full_check_suite", "A7_describe",
    "A16_iqr_outliers", "A21_quality_summary", "W1_average_rank", "M1_grouped_folds",
    "M12_baseline_env_mean", "A24_metrics_by_subset", "A27_group_spearman", "A33_variance_components_loc_year",
    "J6_nearest_neighbours", "A17_correlation_matrix", "E1_out_of_fold_predictions", "M5_knn_imputation", "E9_feature_attribution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("furrow-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_WORK") or tempfile.mkdtemp(prefix="furrow-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    # the given files have one row group each, which one task reads whatever the number of cores: deal them out once
    spread = f"{spark.conf.get('spark.checkpoint.dir')}/tables"
    for table in ("lineitem", "orders", "customer", "nation", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(int(cpus)).write.mode("overwrite").parquet(f"{spread}/{table}.parquet")
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, spread).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
