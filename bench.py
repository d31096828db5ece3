"""Times the headline queries: one JSON line {"metric", "value", "unit", "queries", "sf", "platform"}.

BENCH_SF_DIR names the tables (sf0.1 by default), BENCH_CPUS the threads. Each query is run to its last
row without being collected; the time is the better of two runs, the first of which also warms up.
``platform``: seconds of one load of the insurance platform over the same tables, and of its layers.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession, functions as F

from stratal import queries as catalogue
from stratal.session import session

HEADLINE = [
    "kpi_conversion_and_premium", "kpi_sales_by_year", "kpi_operations_by_provider", "kpi_month_to_date", "kpi_top_agents", "kpi_best_providers",
    "kpi_aging_buckets", "kpi_growth_labels", "mapping_projection", "dedup_lineitem_grain", "dq_valid", "dq_reject_log", "merge_upsert", "scd1_upsert",
    "scd2_versions", "scd2_apply_batch", "pit_join_event_version", "pit_join_by_window", "fact_quotation", "fact_quotation_item", "fact_payment",
    "validation_suite", "mon_run_summary", "conditional_aggregates", "top_n_with_ties",
]


def platform(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds of a load from bronze to validated facts, and from the first step of each layer to its last."""
    from stratal.queries.platform import load

    began = time.perf_counter()
    p = load(spark, sf_dir)
    total = time.perf_counter() - began
    log = p.table("audit", "layer").read()
    took = F.unix_micros(F.max("ended_at")) - F.unix_micros(F.min("started_at"))
    layers = {r["layer"].lower(): round(r["s"] / 1e6, 3) for r in log.groupBy("layer").agg(took.alias("s")).collect()}
    return {"load": round(total, 3)} | layers


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.load()
    took: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = min(took.get(name, 1e9), time.perf_counter() - began)
    sums = platform(spark, sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": os.path.basename(sf_dir.rstrip("/")), "platform": sums}))


if __name__ == "__main__":
    main()
