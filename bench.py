"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

anything remembered: compile (parse, bind, authorise; what the published figures measure but for writing the statement
out and reading it again, which nothing here does) and plan (building and verifying the DataFrame, which Spark analyses).
The other entries are registered queries.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SHAPES = {"simple": "row_policy_basic", "join": "left_join_policy_on", "exists": "exists_semi", "aggregate": "group_having", "window": "row_number_part", "update": "update_preset_check"}
MORE = ("three_way_join", "exists_nested", "group_count", "top_k", "json_extract_scalar", "delete_filtered")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="veilspark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"{folder}/checkpoints").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from veilspark import registered

    try:
        from veilspark.llm.queries import QUERIES as llm
    except ImportError:
        llm = {}
    names = {**{k: registered.QUERIES[q] for k, q in SHAPES.items()}, **{q: registered.QUERIES[q] for q in MORE}, **llm}
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(registered.QUERIES["count_global"](spark, sf_dir))  # start the JVM's code paths
    seconds, compile_ms, plan_ms = {}, {}, {}
    for name, query in names.items():
        runs = []
        for _ in range(1 if name in llm else 2):
            began = time.perf_counter()
            noop(query(spark, sf_dir))
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 3)
    engine = registered.engine(spark, sf_dir)
    statements = {k: registered.SELECTS[q][:2] for k, q in SHAPES.items() if q in registered.SELECTS} | {"update": ("UPDATE customer SET c_name = :n WHERE c_custkey < 100", {"n": "renamed"})}
    from veilspark.plans import syntax

    for name, (sql, params) in statements.items():
        runs = []
        for _ in range(300):
            syntax._remembered.cache_clear()
            began = time.perf_counter()
            compiled = engine.compile(sql, params, registered.session())
            runs.append(time.perf_counter() - began)
        compile_ms[name] = round(median(runs) * 1e3, 4)
        if name == "update":
            continue  # a write's frames read the store that it writes
        runs = []
        for _ in range(5):
            began = time.perf_counter()
            engine._build(compiled, registered.session(), engine.tables)
            runs.append(time.perf_counter() - began)
        plan_ms[name] = round(median(runs) * 1e3, 2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "compile_ms": compile_ms, "plan_ms": plan_ms, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
