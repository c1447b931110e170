"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Names of columns that begin with an underscore are the operators' own; such columns of an input may be replaced or left out.
"""
