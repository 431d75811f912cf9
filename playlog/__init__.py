"""playlog: listening-history analytics as lazily composed Spark DataFrames."""
