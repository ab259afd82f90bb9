"""Print the physical plans of registered queries (``explain("formatted")``)
and a one-line digest of what matters at scale: exchanges, scans' read
schema, group limits, joins.

    python tools/show_plans.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from precis.plans.registry import QUERIES  # noqa: E402
from precis.session import build_session  # noqa: E402

DEFAULT_KEYS = ["summarize_default", "summarize_diverse", "summarize_chunked", "summary_status", "idf_corpus"]


def digest(plan: str) -> str:
    exchanges = re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition)", plan)
    exchanges = [re.sub(r"#\d+L?", "", e) for e in exchanges]
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
    return (
        f"exchanges={exchanges} read={schemas} "
        f"group_limits={plan.count('WindowGroupLimit')} joins={len(re.findall(r'(SortMergeJoin|BroadcastHashJoin)', plan))}"
    )


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    keys = [a for a in args if not a.startswith("/")] or DEFAULT_KEYS
    spark = build_session()
    for key in keys:
        df = QUERIES[key](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {key}: {digest(plan)}")
        if os.environ.get("FULL"):
            df.explain("formatted")


if __name__ == "__main__":
    main()
