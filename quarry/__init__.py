"""Quarry: mining and analytics operators on Spark DataFrames."""
