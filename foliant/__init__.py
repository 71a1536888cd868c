"""foliant: document-structure and scene-timeline analytics on Spark DataFrames."""
