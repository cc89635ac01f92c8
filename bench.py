"""Time the headline queries; prints one JSON line.

Every query runs once to warm up, then three times; its time is the median.
A run builds the query from the Parquet files and computes every output row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from agoralytics.plans.session import local_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "business_summary payment_breakdown state_revenue monthly_revenue_growth category_revenue "
    "top_categories_all_orders repeat_customer_rate delivery_by_state delay_review_impact "
    "delivery_time_histogram delivery_time_kde order_heatmap freight_vs_delivery_by_state "
    "cohort_retention customer_rfm_raw rfm_customer_segments rfm_segment_summary_sql rfm_pandas "
    "rfm_segment_summary seller_pareto top20_sellers order_master order_item_details "
    "review_delay_frame cohort_descriptives welch_t_test mann_whitney_u chi_square_test "
    "null_counts primary_key_check foreign_key_check row_count_audit read_order_items"
).split()
REPEATS = 3


def seconds(spark, key: str, folder: str) -> float:
    begin = time.perf_counter()
    QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cores)
    for key in HEADLINE:
        seconds(spark, key, folder)
    timed = {
        key: round(statistics.median(seconds(spark, key, folder) for _ in range(REPEATS)), 3)
        for key in HEADLINE
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
