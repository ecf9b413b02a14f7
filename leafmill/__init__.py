"""leafmill: document ingestion and text-quality analytics on Spark DataFrames."""
