"""Analytics over operating-system performance traces, on Spark DataFrames."""
