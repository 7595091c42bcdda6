"""Catalogue profiling, target preparation and candidate vetting on Spark DataFrames."""
