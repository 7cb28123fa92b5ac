"""Time headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tabmine.jobs.catalog import QUERIES

HEADLINE = [
    "train_evaluate_gnb", "feature_stats_full", "correlation_matrix", "standard_scale", "stratified_split", "filter_mutual_info",
    "histogram_bins_by_class", "ecdf", "kde_grid", "knn_gaussian", "gnb_predict", "mnb_predict", "c45_tree", "svm_decision", "svm_ovo_linear",
    "kmeans_fit", "silhouette", "mlp_train_adam", "roc_auc", "cv_gnb", "cv_knn",
]


def main() -> None:
    cores, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["gnb_fit"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms the JVM up
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
