from retailforge.sources.tables import read_table, TABLES  # noqa: F401
from retailforge.sources.views import (  # noqa: F401
    retail_lines, marketplace_tables, activity, clv_lines,
)
