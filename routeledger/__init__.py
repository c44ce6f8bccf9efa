"""Trajectory conformance analytics over execution traces, built on PySpark DataFrames."""
