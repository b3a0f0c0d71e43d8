"""Operators of a training-data pipeline: one module for each operator.

``queries`` holds the registered queries, ``sql`` their SQL counterparts.
Nothing outside this subpackage imports it.
"""
