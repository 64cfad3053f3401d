"""Operators for large-scale training-data pipelines.

One module per operator; ``queries`` registers one query for each of them.
Nothing outside this subpackage imports it.
"""
