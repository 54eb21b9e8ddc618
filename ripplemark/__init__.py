"""ripplemark: change-impact analytics over typed dependency graphs, built on Spark DataFrames."""
