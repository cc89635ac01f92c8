"""Time, shuffle volume and evenness of registered queries, from Spark's event log.

    python -m checks.measure <data folder> <log folder> <settings> [key ...]

``settings`` is a comma-separated list such as ``cores=4,spark.sql.x=y``. Prints
a Markdown table. The last column is the largest share of the bytes received by a
stage that went to one of its tasks, over stages that receive many.
"""

from __future__ import annotations

import glob
import json
import statistics
import sys
import time
from collections import defaultdict

from agoralytics.plans.session import local_session
from checks.queries import QUERIES

REPEATS = 3
MANY_BYTES = 16_000_000


def run(folder: str, log_folder: str, settings: dict[str, str], keys: list[str]) -> dict[str, float]:
    spark = local_session(
        int(settings.pop("cores", 4)),
        **{
            **settings,
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": log_folder,
            "spark.eventLog.compress": "false",
            "spark.eventLog.rolling.enabled": "false",
        },
    )
    seconds = {}
    for key in keys:
        times = []
        for attempt in range(REPEATS + 1):
            # only the last run is attributed to the key in the log
            spark.sparkContext.setJobGroup(key if attempt == REPEATS else "warm-up", key)
            begin = time.perf_counter()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[key] = statistics.median(times[1:])
    spark.stop()
    return seconds


def read_log(log_folder: str) -> tuple[dict[int, str], dict[int, list[dict]]]:
    group_of, tasks = {}, defaultdict(list)
    for path in glob.glob(f"{log_folder}/*"):
        with open(path) as lines:
            for event in map(json.loads, lines):
                if event["Event"] == "SparkListenerJobStart":
                    group = event["Properties"].get("spark.jobGroup.id", "")
                    group_of.update({stage: group for stage in event["Stage IDs"]})
                elif event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                    tasks[event["Stage ID"]].append(event["Task Metrics"])
    return group_of, tasks


def received(task: dict) -> int:
    read = task["Shuffle Read Metrics"]
    return read["Local Bytes Read"] + read["Remote Bytes Read"]


def main(folder: str, log_folder: str, settings: str = "cores=4", *keys: str) -> None:
    chosen = list(keys) or list(QUERIES)
    options = dict(item.split("=", 1) for item in settings.split(","))
    seconds = run(folder, log_folder, options, chosen)
    group_of, tasks = read_log(log_folder)
    print("| key | seconds | shuffle MB | largest task |\n|---|---|---|---|")
    for key in chosen:
        stages = [tasks[s] for s, group in group_of.items() if group == key and s in tasks]
        moved = sum(t["Shuffle Write Metrics"]["Shuffle Bytes Written"] for s in stages for t in s)
        shares = [
            max(map(received, stage)) / total
            for stage in stages
            if (total := sum(map(received, stage))) > MANY_BYTES
        ]
        largest = f"{max(shares):.0%}" if shares else "–"
        print(f"| {key} | {seconds[key]:.2f} | {moved / 1e6:.2f} | {largest} |")


if __name__ == "__main__":
    main(*sys.argv[1:])
