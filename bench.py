"""Times the headline queries once each and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import catalog
from tessera.session import get_session

HEADLINE = (
    "panel_dense",
    "features_momentum",
    "features_volatility",
    "ts_rank",
    "cs_rank",
    "bitemporal_known",
    "interval_expand_decay",
    "backtest_stats",
    "cv_folds_stats",
    "feature_ic_table",
    "pbo_cscv",
    "expr_nested_rank_mean",
    "stk_lowvol",
    "opt_theta",
    "wh_group_by_all",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", cores=os.environ.get("BENCH_CPUS", "8"), partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
