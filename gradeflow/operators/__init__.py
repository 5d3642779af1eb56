"""Jobs: functions from DataFrames to a DataFrame."""
