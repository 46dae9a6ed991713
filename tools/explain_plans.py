"""Write PLANS.md: the physical plan (operator tree, scans) of headline queries.

Usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slidecast import queries as Q  # noqa: E402
from slidecast.session import get_spark  # noqa: E402

HEADLINE = ["q4_top_users", "w1_sliding_count", "w1b_sliding_pane_agg", "q3_all_records", "f7_topk",
            "f8_self_join", "s7_bbox_filter", "q5_cross_topic_asof", "q6_ordered_result",
            "f10c_left_join_dataframe_topic"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?ReadSchema: [^\n]+", details)
    keep = []
    for s in scans:
        lines = [ln for ln in s.splitlines() if ln.startswith(("(", "PushedFilters", "ReadSchema"))]
        keep.append("\n".join(lines))
    return tree.strip() + "\n\n" + "\n\n".join(keep)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=8)
    out = ["# Physical plans of headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{os.path.basename(sf)}` (initial AQE plans; "
           "AQE may still turn a sort-merge join into a broadcast or coalesce partitions at run time).", ""]
    for name in HEADLINE:
        df = Q.registry()[name](spark, sf)
        out += [f"## {name}", "", "```", plan_text(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
