"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from tracewell import catalogue

HEADLINE = (
    "layer_money_materiality layer_comm layer_intel_merge layer_co_event layer_co_place fused_graph hetero_edges graph_projection index_lists phonetic_key blocking_candidates jaro_winkler "
    "structuring mule_fanout dormant_passthrough layering_chains burner_jaccard call_burst shared_vehicle_links adamic_adar round_trips components degree_strength clustering modularity pagerank eigenvector kcore betweenness louvain command_span command_scores link_noisy_or er_scored_pairs ner_regex_entities search facets window_counts"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    found["layer_money_materiality"](spark, sf).count()  # starts the JVM's compilers and the file cache
    took = {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
