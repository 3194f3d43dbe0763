"""Headline queries over all companies at one scale; prints one JSON line."""
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kinweave.catalog import all_queries
from kinweave.session import build_session

# The staged tables come first, so that what a query reads is timed once, under its own name.
HEADLINE = ["T_holding", "T_position", "R1", "R2", "R3", "R4", "R5", "R6", "R7", "RE", "RM", "G3", "G4", "Q1", "Q3", "Q4", "Q5", "Q6", "Q8", "Q10",
            "Q11", "EV2", "EV3", "EV6", "D8", "LNK5", "LNK7", "TXT2", "TXT4", "P1", "MRG3", "A2", "W1", "Q9"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, times = all_queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "all subjects per job, total seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
