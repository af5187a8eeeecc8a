"""tidemark: repository-activity mirror and analytics operators for Spark DataFrames."""
