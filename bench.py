"""Prints one JSON line: seconds for each headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import time

from pyspark.sql import SparkSession

from tensorloom import catalogue

HEADLINE = """flagship desc_norms desc_stats norm_range ew_add ew_log matmul_8x8 gram_einsum reduce_dim0 cov_pairs conv1d_valid sparse_matmul sim_cosine knn_filtered
knn_join_top3 hybrid_rank fulltext_score facet_counts nql_meta_range plan_index_lookup co_tags stale lineage_ancestors op_stats changes_latest replica_apply
int8_quant chunk_rebuild svd_values tucker_recon matrix_descriptor ext_tumbling ext_session idx_range query_builder batch_commit op_by_name ivf_probe shard_search
posting_search""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "16").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/embeddings.parquet").count()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
