"""Note-vault and knowledge-graph analytics on PySpark DataFrames."""
