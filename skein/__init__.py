"""Crawl analytics on Spark DataFrames."""
