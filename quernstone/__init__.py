"""Knowledge analytics over exported conversations, documents and change events, on Spark DataFrames."""
