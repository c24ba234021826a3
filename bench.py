"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from flowlens.plans import catalog
from flowlens.session import get_session

HEADLINE = (
    "explain_flows eps_range_join visual_predict minmax_scale lineitem_encoded_scaled one_hot_encode feature_minmax "
    "binary_metrics per_class_metrics adjusted_mutual_info silhouette calinski_harabasz last_n_window "
    "rolling_category_confusion assign_index covariance_matrix knn_exact pca_embed lda_embed ae_category mds_embed "
    "decision_tree stream_replay stream_confusion stream_last_n"
).split()


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("minmax_scale")  # untimed: session start-up and first compilation belong to no query
    seconds = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
