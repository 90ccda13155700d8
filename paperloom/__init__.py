"""paperloom: a PySpark-native engine for page-level document extraction output.

Everything is a DataFrame expression or a small plan over whole tables; rule
tables are arguments, never code paths.  See README.md for the inventory.
"""

__version__ = "0.1.0"
