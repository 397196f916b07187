"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from grootboek.plans.queries import QUERIES
from grootboek.session import local_session

HEADLINE = (
    "kpis",
    "kpis_paycycle",
    "net_by_category",
    "monthly_stack",
    "income_vs_expense",
    "transfers_monthly",
    "saving_series",
    "tx_list_spend",
    "text_memory",
    "loo_suggestions",
    "merchant_majority",
    "queue_mismatch",
    "doubt_flags",
    "bank_import_preview",
    "card_import_preview",
    "refund_follows_charge",
    "settlements",
    "corrected_ledger",
    "knn_top5",
    "point_ids",
    "profile_frequencies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    # The first query of a session pays for starting it.
    QUERIES["year_bounds"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
