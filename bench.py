"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sqltide.functions import sqltext as S
from sqltide.operators import capture, decide, guard, metrics, sessions
from sqltide.operators.guard import GuardOptions
from sqltide.plans import catalog, pipeline, traffic

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def line_traffic(spark):
    """One statement and one message per order line, from the templates of the event traffic."""
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(
        F.monotonically_increasing_id().alias("event_id"),
        F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("user_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")]),
                     (F.col("l_partkey") % 5 + 1).cast("int")).alias("event_type"),
        F.col("l_quantity").alias("value"), F.lit("{}").alias("props"))
    lines.createOrReplaceTempView("bench_lines")
    return [spark.sql(traffic.TABLES[name].format(**{t: "bench_lines" for t in traffic.GIVEN}))
            for name in ("sql_events", "messages")]


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def spread(df):
        """The given tables are single small files; a capture is many."""
        df = df.repartition(int(CPUS)).persist()
        df.count()
        return df

    statements, messages = map(spread, line_traffic(spark))
    n_lines = statements.count()
    events = spread(traffic.table(spark, SF_DIR, "sql_events"))
    messages = messages.withColumn("chunk", F.col("chunk").cast("binary"))
    segments = spread(capture.canonical_conn(traffic.table(spark, SF_DIR, "segments")))
    documents = spread(traffic.table(spark, SF_DIR, "document_sql"))
    results = spread(traffic.table(spark, SF_DIR, "line_results"))
    n_events = events.count()
    classed = decide.with_class(statements)

    benches = {
        "scan_statements": (n_lines, lambda: statements),
        "classify": (n_lines, lambda: statements.select(S.classify_sql(F.col("sql")))),
        "classify_decide": (n_lines, lambda: decide.decide(decide.tx_state(classed))),
        "guard_off": (n_lines, lambda: guard.apply_guard(statements)),
        "guard_time_rewrite": (n_lines, lambda: guard.apply_guard(
            statements, GuardOptions(rewrite_time_functions=True))),
        "guard_all": (n_lines, lambda: guard.apply_guard(statements, GuardOptions(
            exclude_ddl=True, rewrite_time_functions=True, skip_external_deps=True,
            mask_patterns=catalog.MASKS, exclude_tables=("carts",)))),
        "sessionise": (n_lines, lambda: sessions.annotate(messages)),
        "message_events": (n_lines, lambda: sessions.sql_events(messages)),
        "plan_replay": (n_lines, lambda: pipeline.plan_replay(statements)),
        "order_segments": (n_events, lambda: capture.order_segments(segments)),
        "compare_diff": (n_lines, lambda: metrics.diff_summary(
            metrics.compare_results(results, 3.0), None)),
        "exec_histogram": (n_lines, lambda: metrics.exec_histogram(metrics.exec_times(results))),
        "p99": (n_events, lambda: catalog.p99_nearest_rank(spark, SF_DIR)),
        "document_masking": (documents.count(), lambda: guard.mask_sql(documents, catalog.MASKS)),
    }
    wanted = sys.argv[1:] or list(benches)
    seconds, rates = {}, {}
    for name in wanted:
        rows, build = benches[name]
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
        if rows:
            rates[name] = round(rows / min(taken))
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "rows_per_sec": rates, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
