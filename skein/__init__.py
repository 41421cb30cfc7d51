"""Skein: schemas, views, relations and change logs over Spark DataFrames."""
