"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local threads. Each query is run
to the end into a sink that discards the rows; model fits, stored tables and the result all count.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "clean", "clean_audit", "dedup_text", "explode_ratings", "label_stats",
    "extract_webmd", "extract_drugs", "extract_everydayhealth", "extract_drugratingz", "collect_from_names",
    "tokenize", "drop_stopwords", "pos_filter", "bow_fit", "bow_transform", "pos_bow", "tfidf",
    "mean_embedding", "tokens_to_indices", "pad_batches",
    "nb_fit", "nb_predict", "cross_validate", "cv_summary", "evaluate", "classify", "clean_fit_evaluate",
    "stratified_folds", "confusion_matrix", "stream_collect", "stream_classify",
    "rf_fit_predict", "svm_fit_predict", "conv_fit_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from registry import QUERIES

    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()  # warm the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
