"""Operators for training-text pipelines. Nothing else in the library imports this subpackage."""
