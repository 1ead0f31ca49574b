"""Operators for large-scale training-data pipelines. Nothing else in weft imports this package."""
