"""Operators for large-scale training-data pipelines. Nothing else in docwright imports this package."""
