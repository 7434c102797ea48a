"""buywave: purchase-intent analytics on Spark DataFrames.

Every operator takes and returns DataFrames (or Columns) and keeps the work in
Catalyst; see README.md for the map of modules.
"""

__version__ = "0.1.0"
