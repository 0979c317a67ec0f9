"""quarry: relational, sequence and spatial curation of large datasets on Spark DataFrames."""
