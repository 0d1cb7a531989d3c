"""Operators of a training-data pipeline: one module per operator, each with its own interface.

Nothing outside this subpackage imports it.
"""
