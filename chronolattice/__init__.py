"""Time-series clustering engine on PySpark DataFrames."""
