"""Spark-first risk analytics over indexed series, intervals, places and text."""
