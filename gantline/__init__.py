"""Compare generations of tabular feeds, and prepare text corpora, on Spark DataFrames."""
