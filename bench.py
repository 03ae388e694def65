"""Run the headline queries and print one JSON line of seconds.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = ["search_topk", "search_repo_filter", "similar_docs_by_terms", "informative_terms", "stats_grouping_sets", "coauthor_edges", "group_coauthors", "topic_docs", "qgram_jaccard_pairs", "osa_neighbours_r1", "precision_clusters", "lost_letter_repair"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from folioforge.operators import search as S
    from folioforge.plans import queries as engine

    times = {}

    def timed(name, run):
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)

    timed("warm_up", lambda: engine.QUERIES["search_topk"](spark, sf))
    for name in QUERIES:
        timed(name, lambda name=name: engine.QUERIES[name](spark, sf))
    # Warm retrieval on a stored, cached index: one query, and all benchmark texts as one batch.
    from folioforge.functions import text as T
    from folioforge.plans.shared import new_path
    from pyspark.sql import functions as F

    began, path = time.time(), new_path(spark, "bench-index")
    engine._index(spark, sf).write(path)
    times["index_build"] = round(time.time() - began, 3)
    index = S.Index.read(spark, path)
    for name in ("postings", "lengths", "terms", "totals"):
        setattr(index, name, getattr(index, name).cache())
        getattr(index, name).count()
    one = S.query_terms(spark, {"q": "the thing of here"})
    timed("warm_query", lambda: S.top(S.scores(index, one), 10))
    many = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    n = many.select("qid").distinct().count()
    timed("warm_batch", lambda: S.top(S.scores(index, S.informative_terms(index, many).select("qid", "term")), 10))
    times["warm_batch_per_query"] = round(times["warm_batch"] / max(1, n), 4)
    total = round(sum(times[q] for q in QUERIES), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": float(os.path.basename(sf.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
