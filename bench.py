"""Time headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores.

200 of the vectors are queries, the rest is the base. A time is the median of three runs after a warm-up; qps
are whole queries a second. Searches with a fitted rotation don't count the fit, which is build_index.
"""

import json
import os
import shutil
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearplane import catalog
from nearplane.functions import quantization as Q
from nearplane.operators import evaluate, pca, search, topk
from nearplane.plans.sweep import queries_per_second

N_QUERIES, K, HEAD, GROUP, KEEP, RUNS = 200, 10, 48, 4, 50, 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = catalog.vectors(spark, sf_dir)
    queries = rows.where(F.col("id") < N_QUERIES).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    base = rows.where(F.col("id") >= N_QUERIES).select((F.col("id") - N_QUERIES).alias("id"), "v")
    spread = base.repartition(int(cpus))  # one small file is one task; column expressions want all cores
    n = base.count()
    rotation = pca.fit(base)[1]
    folder = tempfile.mkdtemp(prefix="nearplane-bench-")
    pca.save_index(base, f"{folder}/index", d=HEAD, rotation=rotation)
    index = pca.load_index(spark, f"{folder}/index")
    truth = spark.createDataFrame(search.knn_arrow(base, queries, K).select("qid", "rank", "id").toArrow())
    built = iter(range(1000))
    two_phase = lambda turn, refine: lambda: search.search(base, queries, turn, HEAD, K, GROUP, KEEP, refine, n)
    searches = {
        "knn_exact": lambda: search.knn_exact(spread, queries, K),
        "knn_arrow": lambda: search.knn_arrow(base, queries, K),
        "ann_axis_exact": two_phase(None, "exact"),
        "ann_axis_quantized": two_phase(None, "quantized"),
        "ann_search_exact": two_phase(rotation, "exact"),
        "ann_search_quantized": two_phase(rotation, "quantized"),
        "ann_index_exact": lambda: search.search_index(index, queries, K, GROUP, KEEP, "exact", base),
        "ann_index_quantized": lambda: search.search_index(index, queries, K, GROUP, KEEP, "quantized"),
    }
    others = {
        "build_index": lambda: pca.save_index(base, f"{folder}/built{next(built)}", d=HEAD),
        "group_min": lambda: topk.group_min(search.brute_force(spread, queries), topk.fixed_groups(GROUP)),
        "phase1": lambda: search.phase1(base, queries, rotation, HEAD, GROUP, KEEP),
        "sq_info": lambda: base.select("id", Q.sq_info(F.col("v"), 8, 32).alias("x")),
        "covariance": lambda: pca.covariance(base),
        "recall_at_k": lambda: evaluate.recall(two_phase(rotation, "quantized")(), truth, K, N_QUERIES),
    }
    took = {}
    try:
        for name, made in (searches | others).items():
            times = []
            for _ in range(RUNS + 1):
                began = time.perf_counter()
                if (out := made()) is not None:
                    out.write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - began)
            took[name] = round(median(times[1:]), 3)
        recall = {name: round(evaluate.recall(searches[name](), truth, K, N_QUERIES).first()[0], 4) for name in searches}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    qps = {name: queries_per_second(N_QUERIES, took[name]) for name in searches}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "qps": qps, "recall": recall, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
