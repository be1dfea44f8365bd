"""Time the queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is planned and run in full into Spark's ``noop`` sink, so that no
column or row can be optimised away. One pass over all queries warms up, so that
their order does not matter; the median of several further runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from framewright import RECOMMENDED_SETTINGS, obtain_session
from framewright.plans import QUERIES


def seconds(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def scale_factor(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir)
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    settings = {
        **RECOMMENDED_SETTINGS,
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = obtain_session("framewright-bench", f"local[{cpus}]", settings)
    spark.sparkContext.setLogLevel("ERROR")

    for entry in QUERIES.values():
        seconds(entry.run, spark, sf_dir)
    medians = {}
    for name, entry in QUERIES.items():
        timed = [seconds(entry.run, spark, sf_dir) for _ in range(runs)]
        medians[name] = round(statistics.median(timed), 4)

    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(medians.values()), 4),
                "unit": "sec",
                "queries": medians,
                "sf": scale_factor(sf_dir),
                "runs": runs,
                "master": f"local[{cpus}]",
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
