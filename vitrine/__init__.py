"""Retail-catalogue extraction and analytics as Spark DataFrames."""
