"""docsift: document-to-text processing on Spark DataFrames."""
