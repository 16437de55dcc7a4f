"""spindrift: dataset analytics on Spark DataFrames."""
