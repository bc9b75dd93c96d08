"""Operators for large training-data pipelines. Nothing else in cellmill imports this subpackage."""
