"""Sighting timelines, route bounds and feasibility on Spark DataFrames."""
