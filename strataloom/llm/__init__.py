"""Operators for large-scale training-data pipelines. The rest of the library does not import this subpackage."""
