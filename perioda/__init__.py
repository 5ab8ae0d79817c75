"""Period analytics over household and health time-series tables, on PySpark.

Every public function takes and returns DataFrames.  Nothing is collected
except single summary rows that size a plan (see ``operators.ordered``).
"""

from perioda.session import build_session

__all__ = ["build_session"]
