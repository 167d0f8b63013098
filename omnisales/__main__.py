"""Command line: list the analyses, or run them on the test tables or on your own files.

    python -m omnisales list
    python -m omnisales run q01_platform_profitability --tables /root/testdata/sf0.01
    python -m omnisales run all --transactions tx.csv --products product_code.csv --as-of 2026-03-31 \\
        --min-spend 300000 --out reports/

On a cluster start it with spark-submit, or give --master; without either it runs on local[*].
"""

from __future__ import annotations

import argparse
import datetime
import os

from pyspark.sql import SparkSession

from .plans.catalog import TEST_PARAMETERS, registry, run_on
from .plans.incremental import SalesStore
from .plans.sales_view import sales_analysis
from .plans.store import stored_sales
from .session import cli_session, drop_steps
from .sources.files import read_products_csv, read_transactions_csv
from .sources.sinks import write_report


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="omnisales")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("names", nargs="+", help="analysis names, or 'all'")
    run.add_argument("--tables", help="folder with the TPC-H-like test tables")
    run.add_argument("--transactions", help="transaction CSV file(s) (header, text columns)")
    run.add_argument("--products", help="product catalogue CSV")
    run.add_argument("--store", help="folder of a view kept up month by month from --transactions and --products")
    run.add_argument("--out", help="write each result as CSV under this folder instead of printing")
    run.add_argument("--as-of", type=datetime.date.fromisoformat, help="day that recency is counted to (RFM)")
    run.add_argument("--min-spend", type=int, help="spend limit of high-value customers (n5)")
    run.add_argument("--rejects", help="folder for transaction rows with values that cannot be read")
    run.add_argument("--master", help="passed to Spark as it is")
    args = ap.parse_args(argv)
    if args.cmd == "list":
        for name, a in registry().items():
            print(f"{name:40s} {(a.plan.__doc__ or '').strip().splitlines()[0] if a.plan.__doc__ else ''}")
        return
    owned = SparkSession.getActiveSession() is None  # stop only a session started here
    spark = cli_session(args.master)
    given = {"as_of": args.as_of, "min_spend": args.min_spend}
    if args.tables:
        sales = stored_sales(spark, args.tables)
        given = {k: v if v is not None else TEST_PARAMETERS[k] for k, v in given.items()}
    elif args.store and args.transactions and args.products:
        store = SalesStore(spark, args.store, args.transactions, args.products)
        done = store.refresh()
        print(f"{args.store}: {len(done.written)} months written, {len(done.removed)} removed")
        sales = store.read()
    elif args.transactions and args.products:
        sales = sales_analysis(read_transactions_csv(spark, args.transactions, args.rejects),
                               read_products_csv(spark, args.products), extra_product_fields=("reorder_point",))
    else:
        ap.error("give --tables, or --transactions and --products")
    names = None if args.names == ["all"] else args.names
    for name, df in run_on(sales, names, **given).items():
        if args.out:
            write_report(df, os.path.join(args.out, name), fmt="csv")
            print(f"{name}: written")
        else:
            print(f"== {name}")
            df.show(50, truncate=False)
    drop_steps(spark)
    if owned:
        spark.stop()


if __name__ == "__main__":
    main()
