"""quillstone: document analytics and evidence retrieval on Spark DataFrames."""
