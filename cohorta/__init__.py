"""cohorta: product-analytics and experimentation operators for Spark DataFrames."""
