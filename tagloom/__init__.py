"""tagloom: a Spark-first engine for partially labelled multilabel data.

Every operator is a function from DataFrames to a DataFrame (or to a small
named tuple of DataFrames).  Nothing here keeps data on the driver beyond
documented, size-checked dimension tables.
"""

__version__ = "0.1.0"
