"""skein: web-graph and training-data analytics expressed in Spark DataFrames."""
