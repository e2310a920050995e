"""Risk-panel, change-point and calibration analytics on Spark DataFrames."""
