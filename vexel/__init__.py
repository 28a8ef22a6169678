"""A vector store and nearest-neighbour engine whose state and plans are Spark DataFrames."""
