"""gridloom: a PySpark-native analytics engine for gridded numeric data.

Every object is a long DataFrame (one row per cell); operators return
DataFrames and leave the physical plan to Catalyst.
"""

__version__ = "0.1.0"
