"""Listing-intelligence engine on stock PySpark.

Sub-packages: ``sources`` (landed files -> DataFrames), ``functions`` (column
expressions), ``operators`` (joins, windows, grouping, reports), ``plans``
(whole pipelines) and ``streaming`` (micro-batch versions).
"""
