"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and once for the clock, all rows and columns
going to the noop sink.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog import QUERIES
from ruleloom import RuleFile, SingleTest, validate
from ruleloom.operators.reports import rule_summary
from ruleloom.session import tune
from ruleloom.streaming.jobs import work_folder

FROM_CATALOG = (
    "rule_single_test rule_severity_levels testset_all testset_first_fail testset_first_pass testset_nested "
    "verdict_by_sets rule_substitute rule_steps_chain rule_nested_record rule_union rule_array_records "
    "rule_array_primitives substitute_in_array audit_details audit_verdict audit_merge_existing change_type_gate "
    "route_by_schema record_from_json stream_validate dq_rule_summary dq_quality_by_field dq_verdict_by_hour "
    "sample_recent dry_run_trace scalar_string_methods"
).split()


def wide_rules(count: int) -> RuleFile:
    """Many independent tests on lineitem, two of three on the quantity."""
    tests = []
    for n in range(count):
        condition = f"l_quantity + {n} > 0" if n % 3 else f"l_extendedprice > {n * 200}"
        tests.append(SingleTest("l_quantity" if n % 3 else "l_extendedprice", f"rule {n}", condition, ("FAIL", "WARN")[n % 2]))
    return RuleFile.of("lineitem", *tests)


def wide_queries(copy: str):
    """Each wide query on a copy of the table, in as many files as there are cores, and on the given table, a single row group that one
    task reads (``..._one_file``)."""
    for count in (10, 50, 200):
        rules = wide_rules(count)
        for suffix, path in (("", copy), ("_one_file", None)):
            def plain(spark, folder, path=path):
                return spark.read.parquet(path or f"{folder}/lineitem.parquet")

            yield f"details_{count}_rules{suffix}", lambda s, d, r=rules, p=plain: validate(p(s, d), r)
            yield f"verdict_{count}_rules{suffix}", lambda s, d, r=rules, p=plain: validate(p(s, d), r, details="none")
            yield f"summary_{count}_rules{suffix}", lambda s, d, r=rules, p=plain: rule_summary(p(s, d), r)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    copy = work_folder(spark, "bench-lineitem")
    queries = {name: QUERIES[name] for name in FROM_CATALOG} | dict(wide_queries(copy))
    spark.read.parquet(f"{folder}/lineitem.parquet").repartition(int(cpus)).write.parquet(copy)
    seconds = {}
    for name, query in queries.items():
        for _ in range(2):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    result = {
        "metric": "total seconds over all queries",
        "value": round(sum(seconds.values()), 2),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "records_per_second_10_rules": round(rows / seconds["details_10_rules"]),
        "records_per_second_10_rules_one_file": round(rows / seconds["details_10_rules_one_file"]),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
