"""skeinlab: sample comparison, graph analytics and evaluation on Spark DataFrames."""
