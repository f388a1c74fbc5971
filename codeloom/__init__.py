"""codeloom: source-code analytics at corpus scale on Spark DataFrames."""
