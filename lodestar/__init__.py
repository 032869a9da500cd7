"""lodestar: dense-vector search and keyed, versioned data on Spark DataFrames."""

__version__ = "0.1.0"
