"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = """o324_entity_risk o501_daily_rollup o503_first_seen_ledger o302_first_last_seen o305_trail_summary
o306_reputation_features o310_hot_ip_summaries o317_entity_aggregates o322_hourly_trend o325_window_features
o326_event_features o329_baseline_scalars o334_global_statistics o401_latest_deviations o404_gap_statistics
o407_failures_before o410_sequential o601_deviations o603_account_takeovers o604_impossible_travel o605_user_risk
o607_silence_report o610_beacons o611_policy_report o612_coverage_report o614_reputation o617_stages o618_phases
o627_incidents o632_attack_coverage o109_alert_rows""".split()


def main():
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    import checks
    from checks.registry import Tables
    spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").count().collect()          # start the engine
    took = {}
    # what the queries read: the log table, its stored rollups and baselines, each written once
    tables = Tables(spark, folder)
    for name, write in {"store_logs": lambda: tables.logs, "store_rollups": lambda: tables.rollup("agg_ip_daily"),
                        "store_baselines": lambda: tables.baselines}.items():
        start = time.time()
        write()
        took[name] = round(time.time() - start, 3)
    for name in names:
        best = []
        for _ in range(runs):
            start = time.time()
            checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best.append(time.time() - start)
        took[name] = round(sorted(best)[len(best) // 2], 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 2), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
