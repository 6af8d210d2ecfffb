"""Operators of a training-data pipeline: text, vectors and urls at corpus size.

Nothing outside this subpackage imports it.  ``queries`` registers one thin query per operator.
"""
