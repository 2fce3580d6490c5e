"""strandloom: taxonomy-aware k-mer analytics on Spark DataFrames."""
