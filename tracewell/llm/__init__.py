"""Operators for training-data corpora, as Spark jobs over ``documents``-like tables.

Every operator takes and returns DataFrames and never needs the whole input on
the driver, in one task or in one group.  Each module states what it does with
nulls, empty and long texts, repeated rows and extra columns.
"""
