"""docql: JSON query programs and corpus operators compiled to Spark DataFrames."""
