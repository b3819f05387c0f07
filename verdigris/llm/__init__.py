"""Operators for training-data text pipelines; nothing else in the library imports this subpackage."""
