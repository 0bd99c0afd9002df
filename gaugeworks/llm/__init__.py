"""Operators for large training corpora.

Every operator is a function from DataFrames to DataFrames over the columns it
names; other columns of the input are ignored, so clashing names do no harm.
Nothing else in the library imports this package.
"""
