"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. As in the published runs, tables are loaded
before the clock starts, each query runs once to warm up, and the median of three runs counts."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from knotwork.queries import QUERIES, graph

#: The nine shapes of the published workload, in its order (q1 to q9), then others.
SHAPES = ["shape_path", "shape_two_paths", "shape_ring", "shape_star", "shape_wide_star", "shape_fan_out", "shape_optional", "shape_absent", "shape_absent_fan_out"]
HEADLINE = [
    "linear_path_count", "extend_1hop", "extend_2hop", "cycle_close", "multi_type_rel", "unlabelled_rel", "factorized_star_count", "factorized_star_grouped", "optional_chain", "not_exists", "not_exists_pair", "exists_subquery", "count_subquery",
    "agg_grouped", "agg_distinct", "agg_by_node", "topk", "value_hash_join", "var_walk", "undirected_same_label",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    session = graph(spark, sf_dir)
    for t in session.catalog.nodes.values():
        if t.name in ("Region", "Nation", "Customer", "Supplier", "Part", "Orders", "Turn"):
            t.df = t.df.drop("text").cache()
            t.columns = {c: ty for c, ty in t.columns.items() if c != "text"}
            t.df.count()
    for r in session.catalog.rels.values():
        r.pairs = {k: df.cache() for k, df in r.pairs.items()}
        for df in r.pairs.values():
            df.count()
    took = {}
    for name, shown in [(x, f"q{k}") for k, x in enumerate(SHAPES, 1)] + [(x, x) for x in HEADLINE]:
        runs = []
        for k in range(4):
            began = time.time()
            session.execute(QUERIES[name][0]).collect()
            if k:
                runs.append(time.time() - began)
        took[shown] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "graph queries, median of 3 after 1 warm-up, load excluded", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
