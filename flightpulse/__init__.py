"""Flight punctuality and cancellation analysis on Spark."""

from .functions.dialect import dialect_sql, register_sql_functions
from .plans.catalog import REPORTS, report
from .plans.facts import Facts, facts_from_flights
from .plans.rollup import read_pair_totals, read_rollup, write_rollup
from .plans.views import refresh_views, register_stored_views, register_views
from .sources.monthly_csv import read_monthly_directory, read_monthly_files
from .sources.publish import ConcurrentWrite, Store
from .sources.tables import read_flights, write_flights

__all__ = [
    "REPORTS",
    "ConcurrentWrite",
    "Facts",
    "Store",
    "dialect_sql",
    "facts_from_flights",
    "read_flights",
    "read_monthly_directory",
    "read_monthly_files",
    "read_pair_totals",
    "read_rollup",
    "refresh_views",
    "register_sql_functions",
    "register_stored_views",
    "register_views",
    "report",
    "write_flights",
    "write_rollup",
]
