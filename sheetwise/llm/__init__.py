"""Operators of a large-scale training-data pipeline.

Nothing else in the package imports this subpackage: it can be deleted without
touching the rest.
"""
