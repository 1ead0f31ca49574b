"""weft: property graphs as Spark DataFrames, with graph operators as declarative plans."""
