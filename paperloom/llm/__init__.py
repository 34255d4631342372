"""Operators for training-data pipelines over document tables. Nothing outside this subpackage imports it."""
