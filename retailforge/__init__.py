"""retailforge: retail customer analytics as Spark DataFrame jobs.

Every public job is a function ``DataFrame(s) -> DataFrame``. Heavy lifting
stays in Spark SQL / MLlib; pandas appears only inside grouped functions whose
groups are bounded per-series or per-model tables.
"""

__version__ = "0.1.0"
