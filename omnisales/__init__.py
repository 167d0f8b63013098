"""omnisales: retail sales analytics (preparation, sales view, analysis suite) on Apache Spark.

Main entry points::

    from omnisales import (local_session, read_transactions_csv, read_products_csv, sales_analysis,
                           register_view, materialize_sales, stored_sales, registry, run_on)
"""

from .plans.catalog import registry, run_on
from .plans.sales_view import register_view, sales_analysis
from .plans.store import materialize_sales, stored_sales
from .session import local_session, scale_settings
from .sources.files import read_products_csv, read_transactions_csv, read_transactions_parquet

__all__ = ["local_session", "scale_settings", "read_transactions_csv", "read_transactions_parquet",
           "read_products_csv", "sales_analysis", "register_view", "materialize_sales", "stored_sales",
           "registry", "run_on"]
