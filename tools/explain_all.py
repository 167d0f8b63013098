"""Write the executed (AQE final) physical plan of every registered analysis to PLANS.md.

Usage: python tools/explain_all.py [sf_dir] [out]
Expression ids are removed for readability.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from omnisales.plans.catalog import registry  # noqa: E402
from omnisales.plans.store import materialize_sales  # noqa: E402
from omnisales.plans.sales_view import testdata_sales  # noqa: E402
from omnisales.session import local_session  # noqa: E402


def final_plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    if "== Final Plan ==" in text:
        text = text.split("== Final Plan ==", 1)[1].split("+- == Initial Plan ==", 1)[0]
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r", \[plan_id=\d+\]", "", text)
    return "\n".join(line.rstrip() for line in text.strip("\n").splitlines())


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md")
    spark = local_session(8)
    materialize_sales(spark, sf_dir)
    parts = [f"# Executed plans\n\nAQE final physical plans at `{sf_dir}` on `local[8]` "
             "(`tools/explain_all.py`). The first plan builds the shared sales view from the raw tables; every "
             "analysis after it reads that view.\n"]
    view = testdata_sales(spark, sf_dir)
    view.write.format("noop").mode("overwrite").save()
    parts.append(f"## sales view build\n\n```\n{final_plan(view)}\n```\n")
    for name, analysis in registry().items():
        df = analysis.run(spark, sf_dir)
        df.collect()
        parts.append(f"## {name}\n\n```\n{final_plan(df)}\n```\n")
    with open(out, "w") as fh:
        fh.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
