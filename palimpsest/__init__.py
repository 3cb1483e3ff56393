"""Spark-first engine for versioned, semi-structured documents.

Every operator takes DataFrames and returns a DataFrame. Nothing is executed
until the caller acts on the result, unless an operator's docstring says that
it runs a bounded driver-side loop (iterative algorithms do).
"""

__version__ = "0.1.0"
