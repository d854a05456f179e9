"""Search and research analytics as Spark DataFrame operators.

Every operator takes DataFrames (and plain parameters) and returns a DataFrame.
"""

__version__ = "0.1.0"
