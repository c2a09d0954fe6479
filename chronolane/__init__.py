"""Event-timeline and evaluation-statistics operators on Spark DataFrames."""
