"""Untrusted SQL under declarative policies, as Spark DataFrames."""
