"""Operators that audit, review and watch tables and streams, as Spark DataFrames."""
