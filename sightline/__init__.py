"""Sightline: web-visibility analytics on Spark DataFrames."""
