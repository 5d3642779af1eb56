"""Learning analytics as Spark jobs: functions from DataFrames to a DataFrame."""
