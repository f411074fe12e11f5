"""Relationship-pipeline analytics on Spark, as functions from DataFrames to DataFrames."""
