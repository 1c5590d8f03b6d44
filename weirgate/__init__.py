"""Data contracts, table movement, and pipeline analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame; Spark plans, shuffles and runs the work.
"""
