"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).  Each query runs
once to warm up and is then timed into a no-op sink, so all its rows are computed and none are moved to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from typeloom.plans import QUERIES
from typeloom.session import build_session

HEADLINE = (
    "join_inner", "group_by", "declared_types", "coerce_mixed", "assign_types", "parse_typed", "render_display",
    "float_text", "kind_profile", "audit_catalog", "apply_updates", "apply_deletes", "apply_inserts", "apply_changes",
    "delete_cascade", "browse_after", "split_scripts", "create_table_ddl", "export_csv", "export_json",
    "export_markdown", "export_insert", "sorted_table", "sqlite_round_trip", "migrate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "typeloom-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
